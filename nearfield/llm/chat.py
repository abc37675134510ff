"""Chat formatting by token-level assembly.

Each segment (a turn's text) is encoded by itself; the control strings of the
template are reserved ids beyond the vocabulary, spliced between the segments, so no
text can ever yield one. In the text view control strings that occur in content are
escaped reversibly. The loss mask comes from marks +1 and -1 at the borders of
assistant texts, summed up along the sequence.

A turn is encoded, and read back, where it lies. For the digests of conversations what
was read is brought together by conversation and hashed in the order of the turns as a
stream, never gathered: a conversation with a third of all turns needs no more memory
than another, and its one task does nothing but hash.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import pick, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the vocabulary, and the template.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
#: What opens and closes a turn; other roles are named between [ROLE] and [/ROLE].
TURN = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("<s>", "</s>")}
OTHER_END = "</s>"
#: The first character of a control string, backslashes, the rest of it.
GUARDED = r"([\[<])(\\*)(/?INST\]|/?ROLE\]|/?s>|</?SYS>>)"
GUARDED_TOO_OFTEN = r"([\[<])\\(\\*)(/?INST\]|/?ROLE\]|/?s>|</?SYS>>)"


def escape(text: str) -> str:
    """Each control string in ``text`` gets one backslash more after its first
    character, so none is left; ``unescape`` takes it away again."""
    return re.sub(GUARDED, r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return re.sub(GUARDED_TOO_OFTEN, r"\1\2\3", text)


class Codec:
    """Ids of segments and back; ``ranks`` is the vocabulary."""

    _made: dict = {}

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.first = max(ranks.values(), default=-1) + 1
        self.encoding = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.reserved = {c: self.first + i for i, c in enumerate(CONTROL)}
        self.control = dict(zip(self.reserved.values(), self.reserved))

    @classmethod
    def of(cls, shared) -> Codec:
        """One codec for each worker process and vocabulary; see load_ranks."""
        digest, ranks = shared
        if digest not in cls._made:
            cls._made[digest] = cls(ranks.value)
        return cls._made[digest]

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def turn(self, role: str, text: str) -> tuple[list[int], list[int]]:
        """The ids of a turn, and for each id whether it counts for the loss."""
        segments = []
        if role in TURN:
            opening, closing = TURN[role]
            segments.append([self.reserved[opening]])
        else:
            closing = OTHER_END
            segments += [[self.reserved["[ROLE]"]], self.encode(escape(role)), [self.reserved["[/ROLE]"]]]
        segments += [self.encode(escape(text)), [self.reserved[closing]]]
        ends = np.cumsum([len(s) for s in segments])
        marks = np.zeros(ends[-1] + 1, dtype=np.int8)
        if role == "assistant":
            np.add.at(marks, [ends[-3], ends[-2]], [1, -1])
        return [i for s in segments for i in s], np.cumsum(marks[:-1]).tolist()

    def text(self, ids) -> str:
        return self.encoding.decode_bytes(list(ids)).decode("utf-8")

    def parse(self, ids, mask) -> tuple[str, str, str, int]:
        """Role, text, text under the loss mask and formatted length of a turn, read
        back from its ids and mask alone."""
        ids, mask = np.asarray(ids), np.asarray(mask)
        marks = np.flatnonzero(ids >= self.first)
        names = [self.control[i] for i in ids[marks].tolist()]
        body = lambda a, b: self.text(ids[a + 1 : b])
        if names[0] == "[ROLE]":
            raw_role, raw = body(marks[0], marks[1]), body(marks[1], marks[2])
            role = unescape(raw_role)
        else:
            role = next(r for r, (opening, _) in TURN.items() if opening == names[0])
            raw_role, raw = "", body(marks[0], marks[1])
        loss = unescape(self.text(ids[mask == 1]))
        return role, unescape(raw), loss, len(raw_role) + len(raw) + sum(map(len, names))


def load_ranks(spark: SparkSession, path: str):
    """The digest of the vocabulary file, and its entries (tens of thousands, fixed)
    for all executors."""
    with open(path, "rb") as f:
        raw = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x.strip())}
    return hashlib.sha256(raw).hexdigest(), spark.sparkContext.broadcast(ranks)


def format_chat(turns: DataFrame, shared, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role_order, text_order, ids, mask), a row for each turn, where it
    lies. The sequence of a conversation is the ids of its rows in the order of these
    columns (see in_order); text_order is the md5 of the text.

    Null texts and roles count as empty; whole texts are encoded, however long. Rows
    of one turn number follow each other by role, then md5 of the text; a null turn
    comes before all others, and repeated rows stay. A null conversation id is a
    conversation of its own; an empty table gives no rows. Any role is kept; user,
    system and assistant have marks of their own.
    """
    rows = pick(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    rows = rows.withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("text_order", F.md5("text"))
    kinds = dict(rows.dtypes)

    def encode(batches):
        codec = Codec.of(shared)
        for b in slices(batches):
            made = [codec.turn(r, t) for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist())]
            ids = pa.array([m[0] for m in made], pa.list_(pa.int32()))
            mask = pa.array([m[1] for m in made], pa.list_(pa.int8()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "turn", "role", "text_order")), ids, mask], names=["conv_id", "turn", "role_order", "text_order", "ids", "mask"])

    return rows.mapInArrow(encode, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role_order string, text_order string, ids array<int>, mask array<tinyint>")


def in_order(formatted: DataFrame) -> DataFrame:
    """The rows of format_chat, or of read_chat, by conversation and in the order of
    its turns within a partition."""
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role_order", "text_order")


def read_chat(formatted: DataFrame, shared) -> DataFrame:
    """(conv_id, turn, role_order, text_order, role, text, loss, chars, tokens,
    loss_tokens) of each turn, read back from its ids and mask alone: the text under
    the mask is ``loss``, null where it is just the text."""
    kinds = dict(formatted.dtypes)
    order = ["conv_id", "turn", "role_order", "text_order"]

    def parse(batches):
        codec = Codec.of(shared)
        for b in slices(batches):
            out = []
            for ids, mask in zip(b.column("ids"), b.column("mask")):
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy()
                role, text, loss, chars = codec.parse(ids, mask)
                out.append((role, text, None if loss == text else loss, chars, len(ids), int(mask.sum())))
            cols = list(zip(*out)) or [()] * 6
            types = [pa.string()] * 3 + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in order), *(pa.array(c, t) for c, t in zip(cols, types))], names=[*order, "role", "text", "loss", "chars", "tokens", "loss_tokens"])

    return formatted.mapInArrow(parse, ", ".join(f"{c} {kinds[c]}" for c in order) + ", role string, text string, loss string, chars long, tokens long, loss_tokens long")


def digest_chat(formatted: DataFrame, shared) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    n_tokens, n_loss_tokens), a row for each conversation, of what read_chat reads back
    from the ids and masks of ``format_chat``."""
    kind = dict(formatted.dtypes)["conv_id"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"]
    types = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def digest(batches):
        now, out, id_type = None, [], None

        def close():
            out.append([now[0], n[0], turns.hexdigest(), n[1], losses.hexdigest(), *n[2:]])

        def flush():
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t or id_type) for c, t in zip(cols, types)], names=names)

        for b in slices(batches):
            id_type = b.schema.field("conv_id").type
            for conv, role, text, loss, *counts in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss", "chars", "tokens", "loss_tokens"))):
                if now != (conv,):
                    if now is not None:
                        close()
                    now, turns, losses, n = (conv,), hashlib.sha256(), hashlib.sha256(), [0] * 5
                loss = text if loss is None else loss
                turns.update(f"{role}\n{text}\n".encode())
                losses.update(loss.encode())
                for i, x in enumerate((1, len(loss), *counts)):
                    n[i] += x
            if len(out) >= 1000:
                yield flush()
        if now is not None:
            close()
        if out:
            yield flush()

    read = in_order(read_chat(formatted, shared)).select("conv_id", "role", "text", "loss", "chars", "tokens", "loss_tokens")
    return read.mapInArrow(digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long")
