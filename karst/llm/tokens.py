"""Byte-level BPE by a deterministic automaton over tokens.

The states of the automaton are the tokens (and a start), and an arc t -> u means that u may follow t in a correct
encoding. It is compiled by merge gadgets, one per merge rule (a, b) -> w in order of rank: every state with an arc a
gets an arc w, state w gets the arcs of state b, and state a loses its arc b. The gadgets are kept as such - an arc or a
state names the rule that copied it - and an arc is looked up by going back through them; the answers fill the
transition table. Each word has exactly one path through the automaton that spells it; its arc labels are the encoding.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: how byte-level vocabularies of this kind split a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED, LONGEST = 500_000, 64  # words kept with their ids, and the longest that is
POINTS = 1 << 20  # code points that are split at once
CHUNK = 4 << 20  # ids after which a result batch is handed on


def vocabulary_path(name: str = "byte_bpe_50k.json", folder: str = "/opt/tokenizers") -> str:
    return os.path.join(os.environ.get("KARST_TOKENIZERS", folder), name)


def byte_letters() -> dict[str, int]:
    """The letters by which the vocabulary file writes bytes: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_rules(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The id of each byte, and a row (left, right, merged id) for each merge rule."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids, letters = model["vocab"], byte_letters()
    base = np.zeros(256, np.int32)
    for c, b in letters.items():
        base[b] = ids[c]
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    return base, np.array([(ids[a], ids[b], ids[a + b]) for a, b in pairs], np.int32)


LETTER, NUMBER, OTHER, SPACE, BREAK = range(5)
POWERS = np.random.default_rng(1).integers(1, 1 << 62, 4096, np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point, as the pattern's classes have it."""
    table = np.full(0x110000, OTHER, np.int8)
    every = "".join(map(chr, range(0x110000)))
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(name, every):
            table[m.start() : m.end()] = kind
    return table


def words_of(joined: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of the texts as ``PATTERN`` splits them, found by the changes of class in all texts at once: code points, begins, ends, number of the text.

    A run of letters, of digits or of other signs is a word, with one blank before it. Of white space before a word the last
    character stands alone unless it is that blank. 's and the like are words where the sign is no part of a longer run.
    ``joined`` has one character after each text.
    """
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[points]
    stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kind[stops] = BREAK
    start = np.append(True, kind[1:] != kind[:-1])
    start[stops] = True
    runs = np.flatnonzero(start)
    begins = start.copy()
    after = runs[(kind[runs] <= OTHER) & (runs > 0)]
    after = after[kind[after - 1] == SPACE]
    begins[after - 1] = True
    begins[after] = points[after - 1] != 32
    i = runs[(points[runs] == 39) & begins[runs]]
    i = i[kind[i + 1] == LETTER]  # a text ends with a stop, so there is a next character
    one, two = points[i + 1], points[np.minimum(i + 2, len(points) - 1)]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
    begins[i[short | long] + 1] = False
    for at in (i[short] + 2, i[long] + 3):
        begins[at[kind[at] == LETTER]] = True
    begin = np.flatnonzero(begins)
    end = np.append(begin[1:], len(points))
    real = kind[begin] != BREAK
    begin, end = begin[real], end[real]
    return points, begin, end, np.searchsorted(stops, begin)


class Automaton:
    def __init__(self, base: np.ndarray, rules: np.ndarray):
        self.label: dict[int, bytes] = {int(i): bytes([b]) for b, i in enumerate(base)}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.made: dict[int, int] = dict.fromkeys(self.label, -1)
        self.rule: dict[tuple[int, int], int] = {}
        for n, (a, b, w) in enumerate(rules.tolist()):
            self.rule.setdefault((a, b), n)
            if w not in self.made:
                self.left[w], self.right[w], self.made[w] = a, b, n
                self.label[w] = self.label[a] + self.label[b]
        self.ids = {v: k for k, v in self.label.items()}
        self.ends = {v[i:] for v in self.ids for i in range(len(v))}
        self.arcs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def arc(self, t: int, u: int) -> bool:
        known = self.arcs.get((t, u))
        if known is None:
            known = self.arcs[t, u] = self._arc(t, u)
        return known

    def _arc(self, t: int, u: int) -> bool:
        made, before = self.made, len(self.rule) + 1
        while True:
            gone = self.rule.get((t, u))
            if gone is not None and gone < before:
                return False
            mt, mu = made[t], made[u]
            if mt == mu:
                if t != u or mt < 0:
                    return True
                t, u, before = self.right[t], self.left[u], mt
            elif mt > mu:
                t, before = self.right[t], mt
            else:
                if t == self.left[u] == self.right[u]:  # of three in a row, the first two merge
                    return False
                u, before = self.left[u], mu

    def word(self, w: bytes) -> tuple[int, ...]:
        n, ids, ends = len(w), self.ids, self.ends
        last = [-1] * (n + 1)
        for i in range(1, n + 1):
            fits, j = [], i - 1
            while j >= 0 and (part := w[j:i]) in ends:
                if part in ids:
                    fits.append((j, ids[part]))
                j -= 1
            for j, u in reversed(fits):
                if not j or self.arc(last[j], u):
                    last[i] = u
                    break
        out, i = [], n
        while i:
            out.append(last[i])
            i -= len(self.label[last[i]])
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def of_word(self, p: str) -> tuple[int, ...]:
        """The ids of a word, kept if it is short."""
        got = self.words.get(p)
        if got is None:
            got = self.word(p.encode("utf-8"))
            if len(p) <= LONGEST:
                if len(self.words) >= CACHED:
                    self.words.clear()
                    self.arcs.clear()
                self.words[p] = got
        return got

    def _distinct(self, texts: list[str]) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
        """Ids of the distinct words of the texts; then for each word in order its number among those, and the number of its text."""
        joined = "\0".join(texts) + "\0"
        points, begin, end, text_of = words_of(joined, texts)
        if not len(begin):
            return [], begin, text_of
        size = end - begin
        points = np.delete(points, np.cumsum([len(t) + 1 for t in texts]) - 1)  # the words stand side by side in what is left
        at = (begin - text_of).astype(np.int32)
        here = np.arange(len(points), dtype=np.int32)
        place = here - np.repeat(at, size)
        with np.errstate(over="ignore"):
            h = np.add.reduceat((points + np.uint64(1)) * POWERS[place & (len(POWERS) - 1)], at)
        _, first, of = np.unique(h, return_index=True, return_inverse=True)
        # Words of one hash are compared with the first of them, so a result never rests on a hash alone.
        if not (size == size[first][of]).all() or not (points == points[here + np.repeat(at[first][of] - at, size)]).all():
            words = [joined[a:b] for a, b in zip(begin.tolist(), end.tolist())]
            number: dict[str, int] = {}
            of = np.array([number.setdefault(w, len(number)) for w in words])
            return [self.of_word(w) for w in number], of, text_of
        return [self.of_word(joined[a:b]) for a, b in zip(begin[first].tolist(), end[first].tolist())], of, text_of

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, of, text_of = self._distinct(texts)
        length = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(length.sum()))
        start, n = np.cumsum(length) - length, length[of] if len(of) else np.zeros(0, np.int64)
        total = np.cumsum(n)
        out = flat[np.arange(int(total[-1]) if len(n) else 0) - np.repeat(total - n, n) + np.repeat(start[of] if len(of) else n, n)]
        per_text = np.bincount(text_of, n, len(texts)).astype(np.int64)
        return np.split(out, np.cumsum(per_text)[:-1]) if texts else []

    def count_all(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text."""
        ids, of, text_of = self._distinct(texts)
        length = np.array([len(x) for x in ids], np.int64)
        return np.bincount(text_of, length[of] if len(of) else None, len(texts)).astype(np.int64)

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.label[i] for i in ids).decode("utf-8", "replace")


_BUILT: dict[int, Automaton] = {}


def shared_automaton(spark: SparkSession, path: str | None = None):
    """A function that gives each Python worker its automaton, compiled once there from the broadcast rules."""
    sent = spark.sparkContext.broadcast(load_rules(path or vocabulary_path()))

    def get() -> Automaton:
        base, rules = sent.value
        key = hash((base.tobytes(), rules.tobytes()))
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Automaton(base, rules)
        return _BUILT[key]

    return get


def _some(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts, null ones as empty, in lists of about ``POINTS`` code points; a longer text is a list of its own."""
    some, size = [], 0
    for x in texts:
        x = x or ""
        if some and size + len(x) > POINTS:
            yield some
            some, size = [], 0
        some.append(x)
        size += len(x)
    if some:
        yield some


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): the token ids of each text, whole; empty and null texts give an empty list. One row per row of ``df``.

    Text that looks like a special token is ordinary text. Other columns are not looked at.
    """
    d = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    get = shared_automaton(df.sparkSession, path)
    schema = pa.schema([("key", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def work(batches):
        a = get()
        for b in batches:
            begin, parts, ends = 0, [], [0]
            for texts in _some(b["text"].to_pylist()):
                for ids in a.encode_all(texts):
                    parts.append(ids)
                    ends.append(ends[-1] + len(ids))
                if ends[-1] > CHUNK or begin + len(parts) == b.num_rows:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts)))
                    yield pa.RecordBatch.from_arrays([b["key"].slice(begin, len(parts)).cast(pa.int64()), lists], schema=schema)
                    begin, parts, ends = begin + len(parts), [], [0]

    return d.mapInArrow(work, "key long, ids array<int>").withColumnRenamed("key", key)


def count_tokens(df: DataFrame, columns: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """``columns`` and ``n_tokens`` of each row."""
    d = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col(text).alias("text"))
    get = shared_automaton(df.sparkSession, path)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema if f.name != "text")

    def work(batches):
        a = get()
        for b in batches:
            n = pa.array(np.concatenate([np.zeros(0, np.int64), *map(a.count_all, _some(b["text"].to_pylist()))]), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], [*b.schema.names[:-1], "n_tokens"])

    return d.mapInArrow(work, f"{kinds}, n_tokens long").toDF(*columns, "n_tokens")


def decode_ids(df: DataFrame, ids: str = "ids", name: str = "text", path: str | None = None) -> DataFrame:
    """Adds the text that the ids spell (null ids: null)."""
    get = shared_automaton(df.sparkSession, path)

    @F.pandas_udf("string")
    def spell(col):
        a = get()
        return col.map(lambda x: None if x is None else a.decode(x))

    return df.withColumn(name, spell(ids))
