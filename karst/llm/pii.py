"""Personal information in free text: found by a conditional random field over word shapes, replaced by typed placeholders."""

from __future__ import annotations

import unicodedata
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.llm.crf import EDGE, HASHED, NONE, SPAN, Coded, Crf, Group
from karst.llm.pii_table import FAMILY, GIVEN, KINDS, labelled

LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
NAMES = 100_000  # most names of a list that are taken; beyond, the list can't be a table of known names
TABLE_ROWS = 20_000  # rows of the labelled table
POINTS = 1 << 20  # code points coded at once; a longer text is coded alone
DIVIDERS = np.array([ord(x) for x in "<>()[]{}\"“”«»„,;:=|!?¿¡*`"], np.uint32)
BREAK, SPACE, LINE, OTHER, DIGIT, LOWER, UPPER = range(7)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class and small letter of each code point, and a random odd number for each place in a word."""
    kinds = {"Ll": LOWER, "Lo": LOWER, "Lm": LOWER, "Mn": LOWER, "Mc": LOWER, "Me": LOWER, "Lu": UPPER, "Lt": UPPER, "Nd": DIGIT, "Nl": DIGIT, "No": DIGIT, "Zs": SPACE}
    n = 0x20000
    kind = np.fromiter((kinds.get(unicodedata.category(chr(c)), SPACE if chr(c).isspace() else OTHER) for c in range(n)), np.int8, n)
    kind[0], kind[10] = BREAK, LINE
    low = np.fromiter((ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(n)), np.uint64, n)
    low[0xFF20] = 64  # the wide @
    power = np.random.default_rng(1).integers(1, 1 << 62, 64, np.uint64) * np.uint64(2) + np.uint64(1)
    return kind, low, power


def _mix(*parts) -> np.ndarray:
    """One hash of several numbers; never that of an edge or of nothing."""
    h = np.uint64(0x9E3779B97F4A7C15)
    for p in parts:
        h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
    return h | np.uint64(1 << 40)


def _hash(values: np.ndarray, begin: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hash of the values of each segment, the places counted from its begin."""
    with np.errstate(over="ignore"):
        return np.add.reduceat((values + np.uint64(1)) * _tables()[2][np.minimum(place, 63)] * (place >= 0), begin) if len(begin) else np.zeros(0, np.uint64)


def known_names(given: tuple[str, ...], family: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the given and family names of a list and of the public ones."""
    return word_hash([*given, *GIVEN]), word_hash([*family, *FAMILY])


def word_hash(words: list[str]) -> np.ndarray:
    return np.unique(_words(*_points([w for w in words if w and not any(c.isspace() for c in w)]))[2]) if words else np.zeros(0, np.uint64)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each ended by a zero, and their classes."""
    joined = "\0".join(t.replace("\0", " ") if "\0" in t else t for t in texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    return points, _tables()[0][np.minimum(points, len(_tables()[0]) - 1)]


def _words(points: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each token (letters, digits, a line end, any other character) and the hash of its small form."""
    letter = kind >= LOWER
    before = np.append(BREAK, kind[:-1])
    same = (letter & (before >= LOWER)) | ((kind == DIGIT) & (before == DIGIT))
    inside = kind >= LINE
    begin = np.flatnonzero(inside & ~same)
    end = np.append(begin[1:], len(points))
    chars = np.flatnonzero(inside)
    first = np.searchsorted(chars, begin)
    length = np.diff(np.append(first, len(chars)))
    end = begin + length
    place = np.arange(len(chars)) - np.repeat(first, length)
    return begin, end, _hash(_tables()[1][np.minimum(points[chars], len(_tables()[1]) - 1)], first, place)


def coded(texts: list[str], given: np.ndarray, family: np.ndarray) -> tuple[Coded, np.ndarray, np.ndarray]:
    """The texts for the field, with begin and end of each token, in code points of the text."""
    with np.errstate(over="ignore"):
        return _coded(texts, given, family)


def _coded(texts: list[str], given: np.ndarray, family: np.ndarray) -> tuple[Coded, np.ndarray, np.ndarray]:
    points, kind = _points(texts)
    small, power = _tables()[1], _tables()[2]
    begin, end, word = _words(points, kind)
    n = len(begin)
    stop = np.flatnonzero(kind == BREAK)
    text_of = np.searchsorted(stop, begin)
    starts = np.append(np.searchsorted(text_of, np.arange(len(texts))), n)
    offset = np.append(0, stop[:-1] + 1)[text_of]
    at = np.arange(n) + SPAN * (text_of + 1)
    size = n + SPAN * (len(texts) + 1)

    def row(x: np.ndarray, edge) -> np.ndarray:
        out = np.full(size, edge, x.dtype)
        out[at] = x
        return out

    if not n:
        none = Group(np.full((1, 1), EDGE), np.zeros(size, np.int64), (0,))
        return Coded({"word": none, "chunk": none, "run": none}, np.zeros((0, 1), np.int64), at, starts), begin, end
    # Words: shape, beginnings and endings, lists of names.
    length = end - begin
    first, second = kind[begin], kind[np.minimum(begin + 1, end - 1)]
    last = kind[end - 1]
    is_word, digit = first >= LOWER, first == DIGIT
    shape = np.where(is_word, 1 + (first == UPPER) * 2 + (second == UPPER) * 4 + (last == UPPER) * 8 + np.minimum(length, 4) * 16, np.where(digit, 1000 + np.minimum(length, 14), 2000 + points[begin].astype(np.int64)))
    in_list = is_word * (np.isin(word, given) * 1 + np.isin(word, family) * 2)
    low = lambda i: small[np.minimum(points[i], len(small) - 1)]
    word = np.where(digit, _mix(7, length), word)
    uniq, one, of = np.unique(_mix(word, shape), return_index=True, return_inverse=True)
    b, e, w, sh, ls, iw = begin[one], end[one], word[one], shape[one], in_list[one], is_word[one]
    ln = e - b
    heads, tails = [], []
    h = t = np.uint64(0)
    for i in range(4):
        has = ln > i
        h = h + (low(np.minimum(b + i, e - 1)) + np.uint64(1)) * power[i] * has
        t = t + (low(np.maximum(e - 1 - i, b)) + np.uint64(1)) * power[i] * has
        heads.append(h)
        tails.append(t)
    form = lambda k, x, need: np.where(iw & (ln >= need), _mix(k, x), NONE)
    feats = [_mix(1, w), _mix(2, sh), np.where(ls > 0, _mix(3, ls, sh & 14), NONE), form(4, heads[1], 3), form(5, heads[2], 4), form(6, heads[3], 5), form(7, tails[1], 3), form(8, tails[2], 4), form(9, tails[3], 5), np.where(iw, _mix(10, sh & 15, ln >= 3), NONE)]
    edge = np.full((1, len(feats)), NONE)
    edge[0, 0] = EDGE
    words = Group(np.concatenate([np.stack(feats, 1), edge]), row(of, len(uniq)), tuple(range(-SPAN, SPAN + 1)))
    # Chunks: what stands between white space or brackets, quotes and the like; each of those is a chunk of its own.
    solid = kind >= OTHER
    parts = np.isin(points, DIVIDERS) & solid
    opens = solid & (~np.append(False, solid[:-1]) | parts | np.append(False, parts[:-1]))
    c_begin = np.flatnonzero(opens)
    chars = np.flatnonzero(solid)
    chunk_of = np.cumsum(opens)[chars] - 1
    sign = np.where(kind[chars] >= DIGIT, kind[chars], 16 + points[chars].astype(np.int64)).astype(np.uint64)
    sign[points[chars] == 0xFF20] = np.uint64(16 + 64)
    changes = np.append(True, (sign[1:] != sign[:-1]) | (chunk_of[1:] != chunk_of[:-1]))
    kept, owner = sign[changes], chunk_of[changes]
    k_begin = np.searchsorted(owner, np.arange(len(c_begin)))
    squeezed = _hash(kept, k_begin, np.arange(len(kept)) - k_begin[owner])
    f_begin = np.searchsorted(chunk_of, np.arange(len(c_begin)))
    plain = _hash(sign, f_begin, np.arange(len(sign)) - f_begin[chunk_of])
    any_ = lambda x: np.logical_or.reduceat(x, f_begin)
    mark, has_digit, slash, dot = any_(sign == 80), any_(sign == DIGIT), any_(sign == 16 + 47), any_(sign == 16 + 46)
    beside = lambda x: np.where(np.isin(kind[x], [SPACE, LINE, BREAK]), 32, np.minimum(points[x], 200)).astype(np.int64)
    ends_at = np.append(chars[f_begin[1:] - 1], chars[-1:]) + 1
    left, right = beside(np.maximum(c_begin - 1, 0)) * (c_begin > 0), beside(np.minimum(ends_at, len(points) - 1))
    line = kind[begin] == LINE
    c = np.maximum(np.searchsorted(c_begin, begin, "right") - 1, 0) if len(c_begin) else np.zeros(n, np.int64)
    if not len(c_begin):
        squeezed = plain = np.zeros(1, np.uint64)
        mark = has_digit = slash = dot = np.zeros(1, bool)
        c_begin = left = right = np.zeros(1, np.int64)
    opening = np.append(True, (c[1:] != c[:-1]) | line[1:] | line[:-1])
    rank = np.arange(n) - np.maximum.accumulate(np.where(opening, np.arange(n), 0))
    place = np.minimum(rank, 3)
    # Whether an @ stands before or after the token in its chunk, and whether a colon follows the chunk's @.
    marks = np.cumsum(points[begin] == 64) + np.cumsum(points[begin] == 0xFF20)
    edges = np.flatnonzero(opening)
    piece = np.cumsum(opening) - 1
    before_piece = np.append(0, marks)[edges][piece]
    all_marks = np.append(marks[edges[1:] - 1], marks[-1])[piece] - before_piece
    side = np.where(line, 0, 1 + (all_marks > 0) + (marks - before_piece > 0))
    flags = np.where(line, 0, 1 + mark[c] * 2 + has_digit[c] * 4 + slash[c] * 8 + dot[c] * 16)
    sq, pl = np.where(line, np.uint64(3), squeezed[c]), np.where(line | ~has_digit[c], np.uint64(3), plain[c])
    uniq, one, of = np.unique(_mix(sq, pl, place, side, flags, left[c], right[c]), return_index=True, return_inverse=True)
    feats = [_mix(21, sq[one]), _mix(22, pl[one]), _mix(23, flags[one], place[one]), _mix(24, side[one]), _mix(25, sq[one], place[one]), _mix(26, left[c][one], place[one], mark[c][one]), _mix(27, right[c][one], mark[c][one])]
    edge = np.full((1, len(feats)), NONE)
    edge[0, 0] = EDGE
    chunks = Group(np.concatenate([np.stack(feats, 1), edge]), row(of, len(uniq)), (-2, -1, 0, 1, 2))
    # Runs: digits with what joins their groups, white space included.
    joins = np.isin(points, np.array([32, 40, 41, 43, 45, 46, 47, 160], np.uint32)) | (kind == DIGIT)
    r_begin = np.flatnonzero(joins & ~np.append(False, joins[:-1]))
    chars = np.flatnonzero(joins)
    run_of = np.cumsum(joins & ~np.append(False, joins[:-1]))[chars] - 1
    where = np.searchsorted(run_of, np.arange(len(r_begin)))
    is_digit = kind[chars] == DIGIT
    if len(r_begin):
        digits = np.add.reduceat(is_digit.astype(np.int64), where)
        lo = np.minimum.reduceat(np.where(is_digit, chars, len(points)), where)
        hi = np.maximum.reduceat(np.where(is_digit, chars, -1), where)
        core = (chars >= lo[run_of]) & (chars <= hi[run_of])
        pattern = np.add.reduceat(np.where(is_digit, np.uint64(9), points[chars].astype(np.uint64)) * power[np.clip(chars - lo[run_of], 0, 63)] * core, where)
        head = np.minimum.reduceat(np.where(~is_digit & (chars < lo[run_of]) & (points[chars] != 32), points[chars].astype(np.int64), 0) * -1, where)
        zero = points[np.minimum(lo, len(points) - 1)] == 48
        touches = (kind[np.maximum(lo - 1, 0)] >= LOWER) | (kind[np.minimum(hi + 1, len(points) - 1)] >= LOWER)
        r = np.maximum(np.searchsorted(r_begin, begin, "right") - 1, 0)
        inside = joins[begin] & (digits[r] > 0) & (begin >= r_begin[r])
        values = [np.where(inside, x[r], 0) for x in (pattern, np.minimum(digits, 20), -head, zero, touches)]
        part = np.where(inside, 1 + (begin > lo[r]) + (begin < lo[r]) * 3, 0)
    else:
        inside, values, part = np.zeros(n, bool), [np.zeros(n, np.int64)] * 5, np.zeros(n, np.int64)
    uniq, one, of = np.unique(np.where(inside, _mix(*values, part), np.uint64(2)), return_index=True, return_inverse=True)
    v, pt, yes = [x[one] for x in values], part[one], inside[one]
    feats = [np.where(yes, _mix(31, v[0]), NONE), np.where(yes, _mix(32, v[1], v[2] > 0), NONE), np.where(yes, _mix(33, v[2]), NONE), np.where(yes, _mix(34, v[1], v[3], pt), NONE), np.where(yes, _mix(35, v[4], v[1]), NONE)]
    edge = np.full((1, len(feats)), NONE)
    edge[0, 0] = EDGE
    runs = Group(np.concatenate([np.stack(feats, 1), edge]), row(of, len(uniq)), (-1, 0, 1))
    # Joint features of neighbours.
    wr, sr, lr = row(word, EDGE), row(shape, 3), row(in_list, 0)
    s0, l0 = sr[at], lr[at]
    j = [_mix(41, wr[at - 1], s0), _mix(42, sr[at - 1], s0, sr[at + 1]), _mix(43, wr[at + 1], s0), _mix(44, wr[at - 2], wr[at - 1], s0 & 15), _mix(45, l0, s0 & 15, lr[at + 1], sr[at + 1] & 15), _mix(46, sq, place, s0), _mix(47, sr[at - 2], sr[at - 1], s0)]
    joint = (np.stack(j, 1) >> np.uint64(20)) % np.uint64(HASHED)
    return Coded({"word": words, "chunk": chunks, "run": runs}, joint.astype(np.int64), at, starts), begin - offset, end - offset


@lru_cache(maxsize=4)
def model(given: tuple[str, ...], family: tuple[str, ...], rows: int = TABLE_ROWS, part: int | None = None) -> Crf:
    """The field trained on the labelled table; the same lists give the same model. Trained once per process, on the driver."""
    crf = Crf(LABELS)
    table = labelled(rows, given=list(given), family=list(family), part=part)
    lists, parts = known_names(given, family), []
    for i in range(0, len(table), 300):
        c, begin, end = coded([t for t, _ in table[i : i + 300]], *lists)
        y = np.zeros(len(c.at), np.int64)
        for k, (_, items) in enumerate(table[i : i + 300]):
            a, b = c.begin[k], c.begin[k + 1]
            for kind, lo, hi in items:
                inside = a + np.flatnonzero((begin[a:b] >= lo) & (end[a:b] <= hi))
                y[inside] = LABELS.index("I-" + kind)
                y[inside[:1]] = LABELS.index("B-" + kind)
        parts.append((c, y))
    crf.train(parts, hidden={"word": [2, 3, 4, 5, 6, 7, 8]})  # lists, beginnings and endings
    return crf


def items_of(texts: list[str], crf: Crf, given: np.ndarray, family: np.ndarray) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of the items of each text, offsets in code points. Texts are taken whole, several at a time."""
    out: list[list[tuple[str, int, int]]] = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= POINTS):
            size += len(texts[j])
            j += 1
        c, begin, end = coded(texts[i:j], given, family)
        path = crf.decode(c)
        found: list[list[tuple[str, int, int]]] = [[] for _ in range(j - i)]
        is_begin = (path % 2 == 1) & (path > 0)
        starts = np.flatnonzero(is_begin)
        goes_on = (path % 2 == 0) & (path > 0)
        stops = np.flatnonzero(~goes_on)
        upto = np.append(stops, len(path))[np.searchsorted(stops, starts, "right")] if len(starts) else starts
        text_of = np.searchsorted(c.begin, starts, "right") - 1
        for t, a, b, label in zip(text_of.tolist(), starts.tolist(), upto.tolist(), path[starts].tolist()):
            b = min(b, int(c.begin[t + 1]))
            found[t].append((LABELS[label][2:], int(begin[a]), int(end[b - 1])))
        out += found
        i = j
    return out


def name_lists(names: DataFrame | None) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Given and family names of a bounded table of known names (``name``, ``name_kind``); others are ignored."""
    if names is None:
        return (), ()
    rows = names.filter("name is not null").select("name", "name_kind").distinct().limit(NAMES + 1).collect()
    if len(rows) > NAMES:
        raise ValueError(f"more than {NAMES} names are no list of known names")
    return tuple(sorted(r.name for r in rows if r.name_kind == "given")), tuple(sorted(r.name for r in rows if r.name_kind == "family"))


_MODELS: dict[str, tuple] = {}


def _finder(df: DataFrame, names: DataFrame | None):
    given, family = name_lists(names)
    crf = model(given, family)
    name = uuid.uuid4().hex
    sent = df.sparkSession.sparkContext.broadcast((crf.w, *known_names(given, family)))

    def find(texts: list[str]) -> list[list[tuple[str, int, int]]]:
        if name not in _MODELS:
            _MODELS.clear()
            weights, *lists = sent.value
            _MODELS[name] = Crf(LABELS, weights), *lists
        return items_of(texts, *_MODELS[name])

    return find


def find_items(df: DataFrame, names: DataFrame | None = None, key: str = "key", text: str = "text") -> DataFrame:
    """(key, kind, start_pos, end_pos, item) of each item in the texts, offsets in code points; repeated rows give it once.

    Null and empty texts have none. Texts are read whole. ``names``: a table of known names, as a feature; others are found by form and context.
    """
    find = _finder(df, names)
    d = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null and text <> ''")
    schema = pa.schema([("key", pa.string()), ("kind", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("item", pa.string())])

    def work(batches):
        for b in batches:
            texts = b["text"].to_pylist()
            rows = [(k, kind, a, e, t[a:e]) for k, t, found in zip(b["key"].to_pylist(), texts, find(texts)) for kind, a, e in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)

    return d.mapInArrow(work, "key string, kind string, start_pos int, end_pos int, item string").distinct().withColumnRenamed("key", key)


def redact(df: DataFrame, names: DataFrame | None = None, text: str = "text") -> DataFrame:
    """``df`` with each item in ``text`` replaced by a placeholder such as [EMAIL]; all other text, and null or empty texts, unchanged."""
    find = _finder(df, names)

    @F.pandas_udf("string")
    def clean(col):
        texts = [x or "" for x in col]
        out = []
        for x, t, found in zip(col, texts, find(texts)):
            for kind, a, b in reversed(found):
                t = f"{t[:a]}[{kind.upper()}]{t[b:]}"
            out.append(None if x is None else t)
        return pd.Series(out, dtype=object)

    return df.withColumn(text, clean(text))
