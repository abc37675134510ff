"""The same queries as SQL text for DuckDB, each built from common table expressions."""

from __future__ import annotations

M = "4294967295"

DATA = {
    "baskets": "SELECT o_custkey AS id, l_partkey AS f, CAST(sum(l_quantity) AS DOUBLE) AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL HAVING sum(l_quantity) <> 0",
    "tokens": r"SELECT id, CAST('0x' || substr(md5(w), 1, 6) AS BIGINT) AS f, CAST(count(*) AS DOUBLE) AS v FROM (SELECT doc_id AS id, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL",
    "embeddings": "SELECT * FROM (SELECT vec_id AS id, CAST(unnest(range(len(embedding))) AS BIGINT) AS f, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) WHERE v <> 0",
}

#: Column by column, the hash of k in its plain steps of shifts and sums.
MIX = (
    f"(xor(k, {M}) + (k << 15)) & {M} AS m1, xor(m1, m1 >> 12) AS m2, (m2 + (m2 << 2)) & {M} AS m3, xor(m3, m3 >> 4) AS m4, "
    f"(m4 + (m4 << 3) + (m4 << 11)) & {M} AS m5, xor(m5, m5 >> 16) AS h"
)


def hash_text(a: str, b: str) -> str:
    """One expression for the hash of two 32-bit numbers, for use in lambdas."""
    k = f"((({a}) & 65535) * ({b}) + (((({a}) >> 16) * ({b})) & 65535) * 65536) & {M}"
    m = f"((32767 * ({k}) + {M}) & {M})"
    m = f"((xor({m}, {m} >> 12) * 5) & {M})"
    m = f"((xor({m}, {m} >> 4) * 2057) & {M})"
    return f"xor({m}, {m} >> 16)"


def with_(*parts: tuple[str, str], final: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(f"{name} AS ({text})" for name, text in parts) + f"\n{final}"


def data(name: str) -> tuple[str, str]:
    return "x", DATA[name]


def minhash(n: int, of: str = "x", to: str = "s") -> list[tuple[str, str]]:
    return [
        (f"{to}h", f"SELECT id, f, slot, ((f + 1) * (slot + 1)) & {M} AS k, {MIX} FROM {of}, range({n}) AS r(slot)"),
        (to, f"SELECT id, CAST(slot AS INTEGER) AS slot, min(h * 2147483648 + f) % 2147483648 + 1 AS val FROM {to}h GROUP BY id, slot"),
    ]


def wta(n: int, range_k: int, of: str = "x", to: str = "s") -> list[tuple[str, str]]:
    return [
        (f"{to}h", f"SELECT id, f, v, slot, ((f + 1) * (slot + 42)) & {M} AS k, {MIX} FROM {of}, range({n}) AS r(slot)"),
        (f"{to}k", f"SELECT id, slot, h, v FROM {to}h QUALIFY row_number() OVER (PARTITION BY id, slot ORDER BY h, f) <= {range_k}"),
        (to, f"SELECT id, CAST(slot AS INTEGER) AS slot, h AS val FROM {to}k WHERE v > 0 QUALIFY row_number() OVER (PARTITION BY id, slot ORDER BY v DESC, h) = 1"),
    ]


def index(cap: int, prune: int = -1, lsb: int = 0, less: int = -1) -> list[tuple[str, str]]:
    bits = f" AND val & {(1 << lsb) - 1} = 0" if lsb else ""
    out = [
        ("u", f"SELECT * FROM s WHERE val <> 0 AND val <> {M}{bits}"),
        ("b", f"SELECT slot, val, count(*) AS n FROM u GROUP BY slot, val HAVING n < {cap}" + (f" AND n > {prune}" if prune >= 0 else "")),
    ]
    if less > 0:
        out.append(("g", f"SELECT slot FROM b GROUP BY slot HAVING count(*) >= {less}"))
    elif less == 0:
        out += [
            ("gv", "SELECT slot, count(*) AS n FROM b GROUP BY slot"),
            ("gk", "SELECT slot FROM gv WHERE n >= (SELECT avg(n) + stddev_pop(n) FROM gv)"),
            ("g", "SELECT slot FROM gk UNION SELECT slot FROM gv WHERE (SELECT count(*) FROM gk) = 0"),
        ]
    kept = " JOIN g USING (slot)" if less >= 0 else ""
    return [*out, ("i", f"SELECT u.slot, u.val, u.id FROM u JOIN b USING (slot, val){kept}")]


def collisions(minimal: int = 1, queries: str = "i") -> list[tuple[str, str]]:
    return [("c", f"SELECT q.id, i.id AS neighbor_id, count(*) AS cnt FROM {queries} q JOIN i USING (slot, val) WHERE q.id <> i.id GROUP BY ALL" + (f" HAVING cnt >= {minimal}" if minimal > 1 else ""))]


def top(n: int, to: str = "t", of: str = "c") -> list[tuple[str, str]]:
    return [(to, f"SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY cnt DESC, neighbor_id) AS INTEGER) AS rank FROM {of} QUALIFY rank <= {n}")]


def measured(pairs: str, to: str, similarity: bool, queries: str = "x") -> list[tuple[str, str]]:
    measure = "CASE WHEN sqrt(xx) * sqrt(yy) > 0 THEN greatest(0, xy / (sqrt(xx) * sqrt(yy))) ELSE 0 END" if similarity else "sqrt(greatest(0, xx - 2 * xy + yy))"
    return [
        (f"{to}n", "SELECT id, sum(v * v) AS xx FROM x GROUP BY id"),
        (f"{to}d", f"SELECT p.id, p.neighbor_id, sum(a.v * b.v) AS xy FROM {pairs} p JOIN {queries} a ON a.id = p.id JOIN x b ON b.id = p.neighbor_id AND b.f = a.f GROUP BY ALL"),
        (f"{to}m", f"SELECT p.id, p.neighbor_id, coalesce(d.xy, 0) AS xy, n.xx, m.xx AS yy FROM {pairs} p LEFT JOIN {to}d d USING (id, neighbor_id) JOIN {to}n n ON n.id = p.id JOIN {to}n m ON m.id = p.neighbor_id"),
        (to, f"SELECT *, round({measure}, 6) AS distance FROM {to}m"),
    ]


def ranked(of: str, to: str, n: int, similarity: bool) -> list[tuple[str, str]]:
    order = "distance DESC" if similarity else "distance"
    return [(to, f"SELECT id, neighbor_id, distance, CAST(row_number() OVER (PARTITION BY id ORDER BY {order}, neighbor_id) AS INTEGER) AS rank FROM {of} QUALIFY rank <= {n}")]


def expanded(k: int, excess: int, similarity: bool) -> list[tuple[str, str]]:
    """From c, the collisions, to k, the k nearest after one expansion."""
    return [
        *top(k * excess),
        *measured("t", "e", similarity),
        *ranked("e", "r1", min(100, k + excess), similarity),
        ("a", f"SELECT id, neighbor_id FROM r1 UNION SELECT r.id, f.neighbor_id FROM r1 r JOIN r1 f ON f.id = r.neighbor_id WHERE r.rank <= {k} AND f.neighbor_id <> r.id"),
        *measured("a", "e2", similarity),
        *ranked("e2", "k", k, similarity),
    ]


def symmetric(of: str, weight: str) -> str:
    return f"SELECT src, dst, avg(weight) AS weight FROM (SELECT id AS src, neighbor_id AS dst, {weight} AS weight FROM {of} UNION ALL SELECT neighbor_id, id, {weight} FROM {of}) GROUP BY src, dst"
