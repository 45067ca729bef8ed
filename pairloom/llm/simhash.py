"""SimHash near-duplicates with pigeonring filtering.

A text's words, in lower case by A-Z, make shingles; each bit of the 64-bit fingerprint is 1 if set in
over half of the shingles' hashes. Fingerprints at ``max_bits`` differing bits or fewer are linked.

With d allowed bits the 64 bits lie on a ring of d + 1 segments. By the pigeonring principle a linked pair
has a segment to start from such that, for every l, the l consecutive segments from there differ in at
most l * d / (d + 1) bits, rounded down to l - 1: none in the first, one at most in the first two, and so
on. The first two steps of that chain make the join key: a fingerprint goes to the key of each start, and
to the keys with one more bit set in the second segment, so that a pair meets at one side's own key. What
meets is checked along the rest of the chain, then by full Hamming distance.

Keys of very many fingerprints (a large group of near copies) are cut by the third step of the chain: all
its members and those of the keys next to it go on to keys of three segments, with the allowed
differences in the second and third. What is then left is one segment, so such a key has 2**16 own
members at most for three bits. No pair is ever written: a key gives links to one member of each group
that hangs together, at most one per fingerprint and key.

Exact copies share a fingerprint and are one row until the end. Links become classes by distributed
star steps. Nulls: a null text is an empty one, of fingerprint zero, which is linked like any other. A null id
is passed on, and is the smallest of a class only if all its ids are null. Empty table: no rows.
Repeated rows are rows of their own. Other columns of the input are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.common import map_rows, saved
from pairloom.llm.components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
# Fingerprints under one key that one task compares directly.
HOT_KEY = 2048
BLOCK_BYTES = 4 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_BITS = np.array([[value >> bit & 1 for bit in range(8)] for value in range(256)], np.int64)


def _word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text, in lists of bounded size."""
    at = 0
    while at < len(data):
        end = at + BLOCK_BYTES
        if end < len(data):
            found = _SPACE.search(data, end)
            end = found.end() if found else len(data)
        yield data[at:end].split()
        at = end


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned integer."""
    from xxhash import xxh64_intdigest

    # Lower case of bytes changes A-Z alone, and their split knows the same white space as the shingles.
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    counts, total, words = np.zeros(64, np.int64), 0, []
    for block in _word_blocks(data):
        words = words + block
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = [0, *(ends[:-1] + 1).tolist()]
            spans = zip(starts, ends[shingle - 1 :].tolist())
            n = len(words) - shingle + 1
            hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
            counts += _bit_counts(hashes)
            total += n
            words = words[n:]
    if not total and words:
        counts += _bit_counts(np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64))
        total = 1
    return sum(1 << int(bit) for bit in np.flatnonzero(2 * counts > total))


def fingerprints(
    df: DataFrame, carry: Sequence[str] = ("doc_id",), text_col: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """The carried columns and fp, the fingerprint as a signed 64-bit number."""
    schema = T.StructType([T.StructField("fp", T.LongType())])

    def make():
        def run(columns: dict[str, list]) -> dict[str, list]:
            prints = np.array([fingerprint(text, shingle) for text in columns["_text"]], np.uint64)
            return {"fp": prints.view(np.int64)}

        return run

    return map_rows(df.select(*carry, F.col(text_col).alias("_text")), make, schema, carry)


class Ring:
    """Segments of the fingerprint, and keys that chains of them make."""

    def __init__(self, max_bits: int):
        self.n = max_bits + 1
        edges = [64 * i // self.n for i in range(self.n + 1)]
        self.segments = [list(range(a, b)) for a, b in zip(edges, edges[1:])]

    def bits(self, start: int, steps: int) -> list[int]:
        return [bit for i in range(steps) for bit in self.segments[(start + i) % self.n]]

    def mask(self, start: int, steps: int) -> np.uint64:
        return np.uint64(sum(1 << bit for bit in self.bits(start, steps)))

    def changes(self, start: int, steps: int) -> list[np.uint64]:
        """What may differ in a chain of two or three steps: one bit in the second, two in all."""
        second = self.bits(start + 1, 1)
        masks = [(bit,) for bit in second]
        if steps == 3:
            third = self.bits(start + 2, 1)
            masks += [(bit,) for bit in third] + list(combinations(third, 2))
            masks += [(a, b) for a in second for b in third]
        return [np.uint64(sum(1 << bit for bit in bits)) for bits in masks]


def _emit(fps: np.ndarray, ring: Ring, start: int, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(own or changed chain, fingerprint) pairs; of two fingerprints only the smaller changes."""
    mask = ring.mask(start, steps)
    own = fps & mask
    yield own, fps
    if steps < 2:
        return
    for change in ring.changes(start, steps):
        changed = own ^ change
        up = changed > own
        yield changed[up], fps[up]


def _keyed(prints: DataFrame, max_bits: int) -> DataFrame:
    """(start, chain, fp) for all starts, with chains of two segments."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring = Ring(max_bits)
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for start in range(ring.n):
                yield _batch(start, list(_emit(fps, ring, start, min(2, ring.n))))

    return prints.select("fp").mapInArrow(run, "start int, chain long, fp long")


def _batch(start: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    chains, fps = (np.concatenate(column) for column in zip(*parts))
    return pa.RecordBatch.from_pydict(
        {"start": np.full(len(fps), start, np.int32), "chain": chains.view(np.int64), "fp": fps.view(np.int64)}
    )


def _longer(rows: DataFrame, max_bits: int) -> DataFrame:
    """Own rows of hot keys, with chains of three segments."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring = Ring(max_bits)
        for batch in batches:
            starts = batch.column(0).to_numpy()
            fps = batch.column(1).to_numpy().view(np.uint64)
            for start in np.unique(starts).tolist():
                some = fps[starts == start]
                for i in range(0, len(some), 1000):
                    yield _batch(start, list(_emit(some[i : i + 1000], ring, start, 3)))

    return rows.select("start", "fp").mapInArrow(run, "start int, chain long, fp long")


def _joined_up(fps: np.ndarray, own: np.ndarray, ring: Ring, start: int, max_bits: int) -> Iterator[tuple[int, int]]:
    """Links of one key: each member that is reached, with the one that its search began at."""
    steps = min(3, ring.n)
    chain = ring.mask(start, steps)
    budget = steps - 1  # of bits that the chain may differ in
    left = fps
    for seed in fps[own]:
        if not (left == seed).any():
            continue
        left = left[left != seed]
        reach = [seed]
        while reach and len(left):
            differ = left ^ reach.pop()
            viable = np.flatnonzero(np.bitwise_count(differ & chain) <= budget)
            near = viable[np.bitwise_count(differ[viable]) <= max_bits]
            if len(near):
                found = left[near]
                left = np.delete(left, near)
                reach.extend(found)
                for other in found.tolist():
                    yield other, int(seed)


def _links(rows: DataFrame, max_bits: int, steps: int) -> DataFrame:
    """(a, b) links from (start, chain, fp) rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring = Ring(max_bits)
        masks = np.array([ring.mask(start, steps) for start in range(ring.n)], np.uint64)
        rest = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            columns = [np.concatenate([r, batch.column(i).to_numpy()]) for i, r in enumerate(rest)]
            # The last key may go on in the next batch.
            begins = _begins(columns)
            cut = begins[-1] if len(begins) else 0
            rest = tuple(column[cut:] for column in columns)
            yield from solve([column[:cut] for column in columns], begins[:-1], ring, masks)
        if len(rest[0]):
            yield from solve(rest, _begins(rest), ring, masks)

    def _begins(columns) -> np.ndarray:
        starts, chains, _ = columns
        if not len(starts):
            return np.zeros(0, np.int64)
        new = (np.diff(starts) != 0) | (np.diff(chains) != 0)
        return np.concatenate([[0], np.flatnonzero(new) + 1])

    def solve(columns, begins, ring, masks) -> Iterator[pa.RecordBatch]:
        starts, chains, prints = columns
        if not len(begins):
            return
        fps, keys = prints.view(np.uint64), chains.view(np.uint64)
        own = (fps & masks[starts]) == keys
        ends = np.append(begins[1:], len(fps))
        some = np.add.reduceat(own, begins, dtype=np.int64)
        found = []
        for i in np.flatnonzero((ends - begins >= 2) & (some >= 1)):
            begin, end = begins[i], ends[i]
            found.extend(_joined_up(fps[begin:end], own[begin:end], ring, int(starts[begin]), max_bits))
        if found:
            pairs = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"a": pairs[:, 0].copy(), "b": pairs[:, 1].copy()})

    dealt = rows.repartition("start", "chain").sortWithinPartitions("start", "chain")
    return dealt.mapInArrow(run, "a long, b long")


def links(prints: DataFrame, max_bits: int = MAX_BITS, hot_key: int = HOT_KEY) -> DataFrame:
    """Links that join all fingerprints at ``max_bits`` or fewer; ``prints`` has distinct ``fp``."""
    rows = _keyed(prints, max_bits)
    if max_bits < 2:
        return _links(rows, max_bits, max_bits + 1)
    ring = Ring(max_bits)
    own = prints.select(
        "fp",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(start).alias("start"),
                        F.col("fp").bitwiseAND(F.lit(int(ring.mask(start, 2).view(np.int64)))).alias("chain"),
                    )
                    for start in range(ring.n)
                ]
            )
        ).alias("key"),
    ).select("fp", "key.start", "key.chain")
    hot = own.groupBy("start", "chain").count().filter(F.col("count") > hot_key).select("start", "chain")
    changes = F.element_at(
        F.create_map(
            *[
                x
                for start in range(ring.n)
                for x in (F.lit(start), F.array(*[F.lit(int(m.view(np.int64))) for m in ring.changes(start, 2)]))
            ]
        ),
        F.col("start"),
    )
    # A hot key and all keys that its members' changes lead to, or that lead to it.
    around = hot.select("start", "chain", F.explode(changes).alias("change")).select(
        "start", F.col("chain").bitwiseXOR(F.col("change")).alias("chain")
    )
    hot = saved(hot.unionByName(around).distinct(), "simhash-hot")
    if hot.isEmpty():
        return _links(rows, max_bits, 2)
    key = ["start", "chain"]
    cool = _links(rows.join(hot, key, "left_anti"), max_bits, 2)
    # Links over hot keys need the members whose own key is hot or next to a hot one; no other pair
    # meets there, as a pair meets at the own key of one side.
    around_hot = hot.unionByName(
        hot.select("start", "chain", F.explode(changes).alias("change")).select(
            "start", F.col("chain").bitwiseXOR(F.col("change")).alias("chain")
        )
    ).distinct()
    members = own.join(around_hot, key, "left_semi").select("start", "fp")
    return cool.unionByName(_links(_longer(members, max_bits), max_bits, 3))


def print_classes(prints: DataFrame, max_bits: int = MAX_BITS, hot_key: int = HOT_KEY) -> DataFrame:
    """``prints`` and class_fp, the smallest fingerprint that each can reach. ``fp`` is unique there."""
    prints = saved(prints, "simhash-distinct")
    roots = components(links(prints.select("fp"), max_bits, hot_key))
    classed = prints.join(roots, F.col("fp") == F.col("node"), "left").withColumn("class_fp", F.coalesce("root", "fp"))
    return saved(classed.drop("node", "root"), "simhash-classes")


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    hot_key: int = HOT_KEY,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(id, fp, class_fp, component_id) of each row, and the carried columns.

    ``class_fp`` names the class by its smallest fingerprint, ``component_id`` by its smallest id.
    """
    rows = saved(
        fingerprints(df, [id_col, *carry], text_col, shingle).withColumnRenamed(id_col, "_id"),
        "simhash-prints",
    )
    classed = print_classes(rows.groupBy("fp").agg(F.min("_id").alias("least_id")), max_bits, hot_key)
    ids = classed.groupBy(F.col("class_fp").alias("c")).agg(F.min("least_id").alias("component_id"))
    named = classed.join(ids, F.col("class_fp") == F.col("c")).select(
        F.col("fp").alias("f"), "class_fp", "component_id"
    )
    return rows.join(named, F.col("fp") == F.col("f")).select(
        F.col("_id").alias(id_col), "fp", "class_fp", "component_id", *carry
    )


def hex_print(column: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")
