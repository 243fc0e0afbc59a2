"""Problem 6: token ids of a whole corpus, and the number of tokens of each text.

Texts go to a public byte-level BPE tokenizer in Arrow batches. A very long text would hold up its task, so it is cut
into blocks that are encoded in parallel as rows of their own. Between a character and white space after it the
tokenizer's own pattern always splits, so blocks that end there simply follow each other. A long stretch without such a
place is halved anyhow, and tree concatenation mends each join: windows around it are encoded again, growing until their
first and last tokens are those that both sides already have.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 16_384
#: The pattern of the vocabulary's tokenizer, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def tokenizer(path: str) -> tiktoken.Encoding:
    """The tokenizer of a rank file, loaded once per worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, t: tiktoken.Encoding) -> list[int]:
    """Ids of one text; the strings of special tokens are ordinary text, unpaired surrogates become U+FFFD."""
    return t.encode_ordinary(text)


def blocks(text: str, size: int = BLOCK) -> list[tuple[str, bool]]:
    """The text in blocks of ``size`` characters or a little more, each with whether it must be joined to the one before.

    A block ends before white space that follows another character, found within another ``size`` characters; else it
    ends in the middle of a stretch and the next must be joined.
    """
    out, at, joined = [], 0, False
    while len(text) - at > 2 * size:
        found = regex.compile(r"(?<=\S)(?=\s)").search(text, at + size, at + 2 * size)
        end = found.start() if found else at + size
        out.append((text[at:end], joined))
        at, joined = end, not found
    out.append((text[at:], joined))
    return out


def join(left: list[int], right: list[int], t: tiktoken.Encoding, width: int = 16) -> list[int]:
    """The ids of the text whose two parts have the ids ``left`` and ``right``.

    The window takes about ``width`` tokens of either side. If its ids begin and end with the outermost tokens that the
    two sides have there, what lies outside stays as it is: every neighbouring pair of tokens is then one of an encoding
    of its own. Else the window doubles, up to both sides whole. How the pattern splits white space or an apostrophe
    depends on what is next to it, so the edge tokens must hold only letters, only digits or only other signs.
    """
    if not left or not right:
        return left or right
    while True:
        for trim in range(4):  # an edge may lie within a character
            a = left[-width + trim :] if width < len(left) else left
            b = right[: width - trim] if width < len(right) else right
            try:
                text = t.decode_bytes(a + b).decode("utf-8")
            except UnicodeDecodeError:
                continue
            ids = t.encode_ordinary(text)
            starts = len(a) == len(left) or (ids[:2] == a[:2] and _solid(a[:2], t))
            ends = len(b) == len(right) or (ids[-2:] == b[-2:] and _solid(b[-2:], t))
            if starts and ends:
                return left[: len(left) - len(a)] + ids + right[len(b) :]
        if width >= max(len(left), len(right)):
            raise ValueError("the ids are not those of a text")
        width *= 2


def _solid(ids: list[int], t: tiktoken.Encoding) -> bool:
    """Whether the tokens hold signs of one kind only, so that the pattern's splits there depend on no other text."""
    return regex.fullmatch(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}'\ufffd]+", t.decode_bytes(ids).decode("utf-8", "replace")) is not None


def concatenate(parts: list[tuple[list[int], bool]], t: tiktoken.Encoding) -> list[int]:
    """The ids of the blocks in order: neighbours are joined pairwise, level by level, as a tree."""
    level = list(parts)
    while len(level) > 1:
        level = [
            (join(level[i][0], level[i + 1][0], t) if level[i + 1][1] else level[i][0] + level[i + 1][0], level[i][1]) if i + 1 < len(level) else level[i]
            for i in range(0, len(level), 2)
        ]
    return level[0][0]


def _lists(ids: list[list[int]]) -> pa.Array:
    return pa.array(ids, pa.list_(pa.int32()))


def encode_corpus(df: DataFrame, key: str, text: str, ranks: str, block: int = BLOCK, count_only: bool = False) -> DataFrame:
    """``key`` and the token ids (``ids``, array of int) of every row's text, or with ``count_only`` their number (``n_tokens``, int).

    ``ranks`` is the path of a rank file. Every row comes out once, repeated keys included; the ids of a null or empty
    text are an empty list, its number of tokens 0. Whole texts are encoded, without special tokens. Other columns are
    ignored. Texts of up to twice ``block`` characters are encoded where they are read; only the blocks of longer ones
    are shuffled.
    """
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    out, named = ("_n int", "n_tokens") if count_only else ("_ids array<int>", "ids")
    long = F.coalesce(F.length("_text"), F.lit(0)) > 2 * block

    def short_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(ranks)
        for batch in batches:
            ids = [t.encode_ordinary(x) if x else [] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, ids), pa.int32()) if count_only else _lists(ids)], ["_key", out.split()[0]])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(batch.column(2).to_pylist()):
                found = blocks(x, block)
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * n, pa.int64()), pa.concat_arrays([batch.column(1).slice(i, 1)] * n), pa.array(range(n), pa.int32()), pa.array([j for _, j in found]), pa.array([b for b, _ in found], pa.string())],
                    ["_row", "_key", "_place", "_joined", "_text"],
                )

    def block_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(ranks)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], _lists([t.encode_ordinary(x) for x in batch.column(4).to_pylist()])], ["_row", "_key", "_place", "_joined", "_ids"])

    def put_together(parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("_place")
        ids = parts["_ids"].combine_chunks()
        starts = np.flatnonzero(~parts["_joined"].to_numpy())
        runs = []  # only blocks that must be joined leave their Arrow arrays
        for a, b in zip(starts, [*starts[1:], len(ids)]):
            run = ids.slice(a, b - a)
            runs.append(run.flatten() if b == a + 1 else pa.array(concatenate([(x, i > 0) for i, x in enumerate(run.to_pylist())], tokenizer(ranks)), pa.int32()))
        whole = pa.concat_arrays(runs)
        value = pa.array([len(whole)], pa.int32()) if count_only else pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)
        return pa.table({"_key": parts["_key"].slice(0, 1), out.split()[0]: value})

    part = f"_row bigint, _key {kind}, _place int, _joined boolean"
    cut_rows = rows.where(long).select(F.monotonically_increasing_id().alias("_row"), "_key", "_text").mapInArrow(cut_up, f"{part}, _text string")
    encoded = cut_rows.repartition("_row", "_place").mapInArrow(block_ids, f"{part}, _ids array<int>")
    joined = encoded.groupBy("_row").applyInArrow(put_together, f"_key {kind}, {out}")
    return rows.where(~long).mapInArrow(short_texts, f"_key {kind}, {out}").unionByName(joined).toDF(key, named)
