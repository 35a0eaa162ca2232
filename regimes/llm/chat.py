"""Chat formatting by assembly of tokens: reserved ids between separately encoded texts, and a loss mask."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

#: A public byte-level vocabulary (ranks); the path is a parameter of every function.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the public pattern that splits text before the merges of such a vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The template. A user's text stands between the first two, an assistant's between the next two, that of
#: any other role after its name between the last three.
CONTROL = ["[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[TEXT]", "[/ROLE]"]
USER, USER_END, ANSWER, ANSWER_END, ROLE, TEXT, ROLE_END = range(len(CONTROL))
#: A control string in a text, also one that has been escaped any number of times.
_ESCAPED = r"([<\[])(\\*(?:/?s>|/?INST\]|/?ROLE\]|TEXT\]))"
#: Characters that are encoded at a time, and tokens in one row of the result, about.
PIECE, PART = 1 << 16, 1 << 20
FORMATTED = "part long, whole boolean, n_turns long, ids array<int>, mask array<byte>"


def escape(text: str) -> str:
    """``text`` without control strings: each gets a backslash after its first character, and so does what looks like an escaped one."""
    return re.sub(_ESCAPED, r"\1\\\2", text)


def unescape(text: str) -> str:
    """What ``escape`` was given: one backslash less in each escaped control string."""
    return re.sub(_ESCAPED, lambda m: m[1] + m[2].removeprefix("\\"), text)


def vocabulary(spark: SparkSession, path: str = VOCABULARY) -> Broadcast:
    """The vocabulary's file (about 1 MB, whatever the data), read on the driver and sent to the tasks."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


@lru_cache(maxsize=2)
def _encoding(ranks: bytes) -> tiktoken.Encoding:
    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})


class Assembler:
    """Encodes turns and reads them back. Reserved ids follow the vocabulary's, so that no text can yield them."""

    def __init__(self, ranks: bytes):
        self.encoding = _encoding(ranks)
        self.base = self.encoding.max_token_value + 1

    def _ids(self, text: str) -> list[np.ndarray]:
        text = escape(text)
        return [np.array(self.encoding.encode_ordinary(text[i : i + PIECE]), np.int32) for i in range(0, len(text), PIECE)]

    def turn(self, role: str, text: str) -> tuple[np.ndarray, int, int]:
        """A turn's ids, and the range of them that is learned (empty but for an assistant's text)."""
        mark = lambda k: np.array([self.base + k], np.int32)
        if role in ("user", "assistant"):
            first, last, head = (USER, USER_END, []) if role == "user" else (ANSWER, ANSWER_END, [])
        else:
            first, last, head = ROLE, ROLE_END, [*self._ids(role), mark(TEXT)]
        ids = np.concatenate([mark(first), *head, *self._ids(text), mark(last)])
        return ids, *((1, len(ids) - 1) if role == "assistant" else (0, 0))

    def joined(self, turns: list[tuple[np.ndarray, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all turns and their mask: +1 where a learned range starts and -1 where it ends, summed up."""
        ids = np.concatenate([t[0] for t in turns])
        starts = np.cumsum([0, *(len(t[0]) for t in turns)])[:-1]
        steps = np.zeros(len(ids) + 1, np.int64)
        np.add.at(steps, starts + [t[1] for t in turns], 1)
        np.add.at(steps, starts + [t[2] for t in turns], -1)
        return ids, np.cumsum(steps)[:-1].astype(np.int8)

    def _text(self, ids: np.ndarray) -> str:
        return unescape(self.encoding.decode_bytes(ids.tolist()).decode())

    def turns(self, ids: np.ndarray) -> Iterator[tuple[str, str]]:
        """Role and text of each turn of ``ids``."""
        at = np.flatnonzero(ids >= self.base)
        kinds, k = ids[at] - self.base, 0
        while k < len(at):
            role = {USER: "user", ANSWER: "assistant"}.get(int(kinds[k]))
            if role is None:
                role, k = self._text(ids[at[k] + 1 : at[k + 1]]), k + 1
            yield role, self._text(ids[at[k] + 1 : at[k + 1]])
            k += 2

    def learned(self, ids: np.ndarray, mask: np.ndarray) -> Iterator[str]:
        """The texts under the mask, one for each run of it."""
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
        for a, b in zip(edges[::2], edges[1::2]):
            yield self._text(ids[a:b])

    def rendered(self, ids: np.ndarray) -> str:
        """The conversation as one text, control strings and escapes included."""
        at, out, last = np.flatnonzero(ids >= self.base), [], 0
        for i in at.tolist():
            out += [self.encoding.decode_bytes(ids[last:i].tolist()).decode(), CONTROL[ids[i] - self.base]]
            last = i + 1
        return "".join(out)


def formatted(turns: DataFrame, ranks: Broadcast, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations as tokens: ``key, part, whole, n_turns, ids, mask``.

    Rows are ordered by conversation and turn in ranges, one for each task, so that a conversation of very many turns
    is divided among tasks. A row of the result has a run of a conversation's turns, of ``PART`` tokens or little more;
    ``part`` gives the order of a conversation's rows, and ``whole`` tells that the row certainly is all of it (the first
    and the last conversation of a range may go on in another). Each text is encoded by itself, with its control
    strings escaped; reserved ids are put between, and the mask (1 for the tokens of an assistant's text) is summed up.

    Null roles and texts are empty ones; a null ``key`` is a conversation like others; null turns come first. Turns of
    one number go by role, then by a hash of the text; repeated rows are turns like others. Other columns are left out.
    """
    spark = turns.sparkSession
    small_batches(spark)
    rows = turns.select(F.col(f"`{key}`").alias("key"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    # The row's number only parts the copies of a row that is repeated very often.
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("copy", F.monotonically_increasing_id())
    order = ["key", "turn", "role", "hash", "copy"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "role", "text")
    kind = placed.schema["key"].dataType.simpleString()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, first = Assembler(ranks.value), TaskContext.get().partitionId() << 32
        at, held, size, whole, out = None, [], 0, False, []

        def close(all_of_it: bool) -> None:
            nonlocal held, size
            if held:
                ids, mask = made.joined(held)
                out.append((at[0], first, all_of_it, len(held), ids, mask))
            held, size = [], 0

        def batch_of(rows: list[tuple], keys: pa.DataType) -> pa.RecordBatch:
            lists = lambda k, t: pa.ListArray.from_arrays(np.cumsum([0, *(len(r[k]) for r in rows)]).astype(np.int32), pa.array(np.concatenate([r[k] for r in rows]), t))
            columns = [pa.array([r[0] for r in rows], keys), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_()), pa.array([r[3] for r in rows], pa.int64()), lists(4, pa.int32()), lists(5, pa.int8())]
            return pa.RecordBatch.from_arrays(columns, ["key", "part", "whole", "n_turns", "ids", "mask"])

        keys = None
        for batch in batches:
            keys = batch.schema.field(0).type
            for k, r, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if at is None or at[0] != k:
                    close(whole)
                    whole = at is not None
                    at = (k,)
                    first += 1
                elif size >= PART:
                    whole = False
                    close(whole)
                    first += 1
                held.append(made.turn(r, t))
                size += len(held[-1][0])
            if out:
                yield batch_of(out, keys)
                out = []
        close(False)
        if out:
            yield batch_of(out, keys)

    return placed.mapInArrow(assemble, f"key {kind}, {FORMATTED}").withColumnRenamed("key", key)


READ = "said binary, learned binary, loss_chars long, formatted_chars long"


def read_back(ranks: Broadcast, ids: Column, mask: Column) -> Column:
    """What a row of ``formatted`` holds: ``said`` (role, line feed, text and line feed of each turn), ``learned`` (all text under the mask), ``loss_chars`` (its code points) and ``formatted_chars``."""

    @F.arrow_udf(READ)
    def read(ids: pa.Array, mask: pa.Array) -> pa.Array:
        made, rows = Assembler(ranks.value), []
        for i in range(len(ids)):
            x, m = ids[i].values.to_numpy(), mask[i].values.to_numpy()
            said = "".join(f"{r}\n{t}\n" for r, t in made.turns(x))
            learned = "".join(made.learned(x, m))
            rows.append((said.encode(), learned.encode(), len(learned), len(made.rendered(x))))
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [x.split()[0] for x in READ.split(", ")])

    return read(ids, mask)


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(table: DataFrame, ranks: Broadcast, key: str = "conv_id") -> DataFrame:
    """``key`` with numbers and digests of what ``formatted`` made, read back from its tokens and mask.

    A row that is a whole conversation is digested where it is. The others, some at the ends of each range and the
    parts of very long conversations, are read back where they are too; then their bytes are put in order by
    conversation and hashed as they come, as a digest can't be made in parts.
    """
    got = table.select(F.col(f"`{key}`").alias("key"), "part", "whole", "n_turns", read_back(ranks, F.col("ids"), F.col("mask")).alias("r"))
    hexes = lambda c: F.sha2(F.col(c), 256)
    whole = got.where("whole").select("key", "n_turns", hexes("r.said").alias("turns_sha256"), "r.loss_chars", hexes("r.learned").alias("loss_sha256"), "r.formatted_chars")
    parts = got.where("NOT whole").select("key", "part", "n_turns", "r.*").repartition("key").sortWithinPartitions("key", "part")
    kind = parts.schema["key"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, out = None, None, []
        for batch in batches:
            keys = batch.schema.field(0).type
            for k, _, n, said, learned, loss, chars in zip(*(c.to_pylist() for c in batch.columns)):
                if at is None or at[0] != k:
                    if at is not None:
                        out.append(at)
                    at = [k, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                at[1], at[3], at[5] = at[1] + n, at[3] + loss, at[5] + chars
                at[2].update(said)
                at[4].update(learned)
        if at is not None:
            out.append(at)
            columns = [[r[0] for r in out], [r[1] for r in out], [r[2].hexdigest() for r in out], [r[3] for r in out], [r[4].hexdigest() for r in out], [r[5] for r in out]]
            kinds = [keys, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["key", *(x.split()[0] for x in DIGESTS.split(", "))])

    return whole.unionByName(parts.mapInArrow(hashed, f"key {kind}, {DIGESTS}")).withColumnRenamed("key", key)
