"""Benchmark decontamination by template canonicalisation.

Every word becomes a template word: a number becomes ``<num>``, a unit after it ``<unit>``, a
capitalised word inside a sentence ``<name>``; any other word is lower-cased and stripped of outer
marks. Windows of ``WINDOW`` template words are hashed and joined with the windows of the benchmark.
Of each (document, item) that shares windows, a run of them at one offset covers part of the item.
Its slots must agree: within the run, one placeholder value of the item always stands for one value
of the document and the other way round, so that a question with other numbers, names or units is
caught while a chance meeting of placeholders is not. A pair is reported where agreeing windows cover
``coverage`` or more of the item's words, or where ``LONG`` or more words of it agree in one run. Items
of less than 25 words have shorter windows, a third of their words but ``LEAST`` at least, so that one
changed word leaves enough windows on its sides.

The benchmark's windows are broadcast as a sorted array where they are at most ``MAX_WINDOWS``; beyond
that, windows of documents and of the benchmark are joined by a shuffle on their hash. Both ways end
in the same check of template words and slots against the item, which needs the items' texts: those
are broadcast with the windows, or joined by item.

Edge cases: items of less than ``WINDOW`` words are one window of what they have, if that is
``SHORTEST`` words or more; null and empty texts match nothing; equal items are all reported; documents
with a null id are reported with that, in either way; rows that repeat an id are reported once for each
item that any of them holds; empty tables give no rows; texts of any length are searched whole; other
columns are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, fold, materialize, maybe_broadcast

WINDOW, SHORTEST, LEAST, LONG, COVERAGE = 8, 5, 3, 20, 0.6
#: Words of documents that are looked up together.
TOGETHER = 50_000
#: Windows of the benchmark that may be broadcast (16 bytes each, and their items' texts).
MAX_WINDOWS = 2_000_000

# Names of units that may follow a number.
UNITS = frozenset(
    "mm cm dm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t ton tons tonne tonnes lb lbs pound pounds oz ounce ounces ml cl l litre litres liter liters gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "hz khz mhz ghz w kw mw v kv a ma j kj cal kcal pa kpa bar k c f degree degrees mph kmh "
    "usd eur gbp dollar dollars euro euros cent cents percent % $ €".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th)?%?$")
_EDGES = ".,;:!?\"'()[]{}«»“”‘’…*#&%$|"
NUM, UNIT, NAME = (xxhash.xxh3_64_intdigest(f"<{x}>") for x in ("num", "unit", "name"))
_CAP, _ENDS, _NUMERIC, _UNIT = 1, 2, 4, 8


class _Word(dict):
    """Hashes of words whose lowest four bits are their flags, remembered up to a bound."""

    LIMIT = 1_000_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        bare = word.strip(_EDGES)
        low = bare.lower()
        flags = (_CAP if bare[:1].isupper() and any(x.islower() for x in bare[1:]) else 0) | (_ENDS if word.rstrip("\"')]»”’")[-1:] in (".", "!", "?", ":") else 0)
        flags |= (_NUMERIC if _NUMBER.match(bare) else 0) | (_UNIT if low in UNITS else 0)
        got = self[word] = xxhash.xxh3_64_intdigest(low) & ~15 | flags
        return got


def template(text: str | None, cache: _Word) -> tuple[np.ndarray, np.ndarray]:
    """Template hashes and value hashes (0 where a word is no slot) of a text's words."""
    words, after_line = [], []
    for line in (text or "").split("\n"):
        if got := line.split():
            after_line.append(len(words))
            words += got
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    packed = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    value, flags = packed & ~np.uint64(15), packed.astype(np.uint8) & 15
    starts = np.zeros(len(words), bool)
    starts[after_line] = True
    starts[1:] |= (flags[:-1] & _ENDS) > 0
    number = (flags & _NUMERIC) > 0
    unit = np.zeros(len(words), bool)
    unit[1:] = ((flags[1:] & _UNIT) > 0) & number[:-1]
    name = ((flags & _CAP) > 0) & ~starts & ~number & ~unit
    shape = value.copy()
    shape[number], shape[unit], shape[name] = NUM, UNIT, NAME
    return shape, np.where(number | unit | name, value, np.uint64(0))


def width(words: int) -> int:
    """Words of the windows of an item."""
    return words if words < WINDOW else max(LEAST, min(WINDOW, (words - 1) // 3))


def windows(shape: np.ndarray) -> np.ndarray:
    return fold(shape, width(len(shape))) if len(shape) >= SHORTEST else np.empty(0, np.uint64)


def covered(item: tuple[np.ndarray, np.ndarray], doc: tuple[np.ndarray, np.ndarray], starts: list[tuple[int, int]]) -> tuple[int, int, int]:
    """Item windows at ``starts`` (item position, document position) whose slots agree along their offset, and the words they
    cover; the most of any offset's and those near it. Then the longest run of words at one offset."""
    size = width(len(item[0]))
    by_offset: dict[int, set[int]] = {}
    for p, q in starts:
        by_offset.setdefault(q - p, set()).add(p)
    seen: dict[int, set[int]] = {}
    for offset, places in by_offset.items():
        there: dict[int, int] = {}
        back: dict[int, int] = {}
        ok: set[int] = set()
        for p in sorted(places):
            a, b = item[1][p : p + size], doc[1][p + offset : p + offset + size]
            if not np.array_equal(item[0][p : p + size], doc[0][p + offset : p + offset + size]):
                continue
            slots = [(int(x), int(y)) for x, y in zip(a, b) if x]
            if all(there.get(x, y) == y and back.get(y, x) == x for x, y in slots):
                there.update(slots)
                back.update((y, x) for x, y in slots)
                ok.add(p)
        seen[offset] = ok
    near = [set().union(*(v for k, v in seen.items() if abs(k - offset) <= WINDOW)) for offset in seen]
    words = [len({w for p in places for w in range(p, p + size)}) for places in near]
    run = 0
    for ok in seen.values():
        first = last = None
        for p in sorted(ok):
            if last is None or p > last + size:
                first = p
            last = p
            run = max(run, last + size - first)
    return max(map(len, near), default=0), max(words, default=0), run


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("item_text")).where("item_id is not null")


def _match_broadcast(items: list[tuple[int, str]], coverage: float):
    cache = _Word()
    made = [(i, template(t, cache)) for i, t in items]
    wins = [windows(m[0]) for _, m in made]
    keys = np.concatenate([np.empty(0, np.uint64), *wins])
    owner = np.repeat(np.arange(len(made)), [len(w) for w in wins])
    place = np.concatenate([np.empty(0, np.int64), *[np.arange(len(w)) for w in wins]]).astype(np.int64)
    widths = np.array([width(len(m[0])) for _, m in made], dtype=np.int64)[owner] if len(owner) else owner
    tables = {}
    for size in sorted(set(widths.tolist())):
        of = np.flatnonzero(widths == size)
        of = of[np.argsort(keys[of], kind="stable")]
        tables[size] = keys[of], owner[of], place[of]
    total = [len(w) for w in wins]

    def pairs(docs: list[tuple]) -> Iterator[tuple]:
        """(id, item, windows, windows of the item) of documents (id, template, values), whose windows are looked up together."""
        # a 0 between two documents is in no window of an item
        words = np.concatenate([x for d in docs for x in (d[1], np.zeros(1, np.uint64))])
        first = np.concatenate(([0], np.cumsum([len(d[1]) + 1 for d in docs])))
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for size, (known, of, at) in tables.items():
            if len(words) < size:
                continue
            h = fold(words, size)
            lo = np.searchsorted(known, h)
            hit = np.flatnonzero(known[np.minimum(lo, len(known) - 1)] == h)
            if not len(hit):
                continue
            hi = np.searchsorted(known, h[hit], "right")
            whose = np.searchsorted(first, hit, "right") - 1
            for q, n, d in zip(hit.tolist(), hi.tolist(), whose.tolist()):
                for j in range(lo[q], n):
                    found.setdefault((d, int(of[j])), []).append((int(at[j]), q - int(first[d])))
        for (d, k), starts in sorted(found.items()):
            n, held, run = covered(made[k][1], docs[d][1:], starts)
            if held >= coverage * len(made[k][1][0]) or run >= LONG:
                yield docs[d][0], made[k][0], n, total[k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Word()
        for batch in batches:
            out, docs, words = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs.append((i, *template(text.as_py(), cache)))
                words += len(docs[-1][1])
                if words >= TOGETHER:
                    out += pairs(docs)
                    docs, words = [], 0
            if docs:
                out += pairs(docs)
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "windows", "item_windows"])

    return run


def _emit(sizes: list[int] | None):
    """(key, owner) for each distinct window of each row, of ``sizes`` or of an item's own, for the way without a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Word()
        for batch in batches:
            key, owner = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                shape = template(t.as_py(), cache)[0]
                w = np.unique(np.concatenate([np.empty(0, np.uint64), *[fold(shape, k) for k in sizes if len(shape) >= k]]) if sizes is not None else windows(shape))
                key.append(w.view(np.int64))
                owner.append(np.full(len(w), i, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *key])), pa.array(np.concatenate([np.empty(0, np.int64), *owner]))], names=["key", "owner"])

    return run


def _widths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the windows of each item that has any; there are few different ones."""
    cache = _Word()
    for batch in batches:
        words = [len(template(t.as_py(), cache)[0]) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([width(n) for n in words if n >= SHORTEST], pa.int32())], names=["size"])


def _check_pairs(coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, t, i, s in zip(*(batch.column(k).to_pylist() for k in range(4))):
                for got in _match_broadcast([(i, s)], coverage)(iter([pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([t])], names=["a", "b"])])):
                    out += list(zip(*(c.to_pylist() for c in got.columns)))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "windows", "item_windows"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """(doc_id, item_id, windows, item_windows) of each document that holds an item, to ``coverage`` of its words or a run of ``LONG``."""
    items = _items(benchmark, item_col, item_text)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, windows long, item_windows long"
    size = items.agg(F.count(F.lit(1)), F.sum(F.size(F.split("item_text", r"\s+"))), F.sum(F.octet_length("item_text"))).first()
    if (size[1] or 0) <= max_windows:
        return src.mapInArrow(_match_broadcast([tuple(r) for r in items.collect()], coverage), schema).distinct()
    ours = items.mapInArrow(_emit(None), "key long, owner long").withColumnRenamed("owner", "item_id")
    # rows are told apart by what their text hashes to: equal texts hold the same items, whatever their ids
    told = src.withColumn("hash", F.xxhash64("text")).where("text is not null")
    sizes = [r[0] for r in items.select("item_text").mapInArrow(_widths, "size int").distinct().collect()]
    theirs = told.select("hash", "text").mapInArrow(_emit(sizes), "key long, owner long").withColumnRenamed("owner", "hash")
    pairs = materialize(theirs.join(materialize(ours, "windows"), "key").select("hash", "item_id").distinct(), "pairs")
    full = told.join(pairs, "hash").join(maybe_broadcast(items, size[0]) if (size[2] or 0) <= BROADCAST_BYTES else items, "item_id").select("id", "text", "item_id", "item_text")
    return full.mapInArrow(_check_pairs(coverage), schema).distinct()
