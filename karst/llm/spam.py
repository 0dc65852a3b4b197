"""Keyword-stuffed pages, link lists and product tags, by the way their terms recur.

Spam of this kind draws phrase after phrase from a few terms: the same words come back at short gaps, in ever new order,
at any distance alike, and without the function words of sentences. Code, data and prose recur in other ways: words come
back in fixed places, only nearby, between function words, or not in phrases at all. So each text is read as words joined to
phrases, and judged by recurrence gaps, by autocorrelation in lag windows, by the neighbours a term has, and by the share
of its characters that such phrases, links with them and list entries cover. Three forms are told apart: shuffled terms,
whole phrases that come back at gaps more even than chance would make them, and long lists of ever new nouns without
function words. No list of advertising words or hosts is used, and no limit changes with the length of the text by a step.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    """
a about after again all also am an and any are as at be because been before but by can could did do does each every for from had has have he her here his how i if in into is it its
may more most must no not of on one only or other our own same she so some such than that the their them then there these they this those to too two until very was we were what when which
while who will with without would you your
aber als alle alles an auch auf aus bei beim bitte das dem den der des die dies diese du durch ein eine einem einen einer er es für hat ich ihr im in ist ja jede jeder kann kein man mit nach
nicht noch nur oder sich sie sind so über um und uns unter vom von vor war wenn werden wie wir wird zu zum zur
au aucun aux avant avec ce ces cette chaque dans de des donc du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour que qui sa sans se ses si son sont sous sur tout toute un une vous y à
al como con cada del desde después dos el ella ellos entre era es esta está este hay lo las los más muy nos otra para pero por porque qué según ser sin sobre son su sus también te tiene toda todo una unos ya
""".split()
)
HIDDEN = re.compile("[​-‏⁠﻿­]|(?<=[\\p{L}\\d])[·•*|~^¦](?=[\\p{L}\\d])")  # characters put into words
COMMENT = re.compile(r"<!--(.*?)(?:-->|$)", re.S)
AUTOLINK = re.compile(r"<((?:https?:|mailto:|www\.)[^<>\s]*)>", re.I)
TAG = re.compile(r"</?[a-zA-Z!?][^<>]*>")
VALUE = re.compile(r"""([\w:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
# Attributes of markup that say how, not what.
STRUCTURE = frozenset("class id style rel type role lang charset width height for method target align border colspan rowspan version xmlns encoding viewbox d fill stroke x y transform http-equiv media sizes".split())
URL = re.compile(r"(?:https?://|www\.)[^\s<>\"'()\[\]]+", re.I)
HOST_END = re.compile(r"\.[a-z]{2,12}/[^\s<>\"'()\[\]]*", re.I)  # the end of a host and what follows it; the host is found backwards from there
OTHER, LOWER, UPPER, DIGIT = range(4)
JOINS = np.isin(np.arange(128), [ord(c) for c in "-_+ "])  # characters that join words to a phrase


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point: small and caseless letters with their marks, capitals, decimal digits."""
    kinds = {"Ll": LOWER, "Lo": LOWER, "Mn": LOWER, "Mc": LOWER, "Me": LOWER, "Lu": UPPER, "Nd": DIGIT}
    return np.array([kinds.get(unicodedata.category(chr(c)), OTHER) for c in range(0x30000)], np.int8)


def _words(t: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text's code points, and begin and end of its words: runs of digits, of capitals, or of letters with at most one capital, the first."""
    points = np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32)
    table = _classes()
    c = np.zeros(len(points) + 2, np.int8)
    c[1:-1] = table[np.minimum(points, len(table) - 1)]
    here, before, after = c[1:-1], c[:-2], c[2:]
    begins = ((here == DIGIT) & (before != DIGIT)) | ((here == LOWER) & (before != LOWER) & (before != UPPER)) | ((here == UPPER) & ((before != UPPER) | (after == LOWER)))
    begin = np.flatnonzero(begins)
    ends = (here != OTHER) & ((after == OTHER) | np.append(begins[1:], True))
    return points, begin, np.flatnonzero(ends) + 1


ENTRY = re.compile(r"^\s*[/|,;•>]?\s*$")
# What stands between the entries of a list within a line: white space (1) and one sign (2), with a # (3) before a tag; anything else (-1) ends the list.
SIGNS = np.full(0x2023, -1, np.int8)
SIGNS[[32, 9, 160]], SIGNS[[ord(c) for c in ",;|·•/"]], SIGNS[35] = 1, 2, 3
WINDOWS = ((1, 8), (9, 32), (33, 128))
FEATURES = ("words", "covered", "repeated", "regular", "chance", "mixing", "phrase_length", "sentences", "function_words", "numbers", "entries", "listed", "distinct", "listed_function_words")


@dataclass(frozen=True)
class Rule:
    """Limits beyond which a text is spam; ``gap`` is the mean distance in words at which a term counts as recurring."""

    gap: float = 80
    covered: float = 0.38  # share of the word characters in phrases of recurring terms, links with such, and list entries;
    few: float = 0.3  # so much more of a text without length,
    half: float = 60  # and half of that for each so many words
    more: float = 160  # a term must recur once more when so many words become twice as many, and again
    regular: float = 0.022  # chance that a term equals the one at a lag, in each lag window, or
    shuffled: float = 0.6  # so much of what it would be if the text's terms were shuffled, where function words are as rare as in a list
    mixing: float = 0.25  # variety of a term's neighbours, less twice the function words and the sentences
    phrase_length: float = 2.35
    sentences: float = 0.35
    numbers: float = 0.36
    repeated: float = 0.5  # share of the characters in phrases of three words that recur, and links with them
    uneven: float = 1.6  # most ratio of deviation and mean of a phrase's recurrence gaps; chance makes it about 1
    repeated_function_words: float = 0.36
    repeated_numbers: float = 0.15
    listed: float = 0.5  # share of the characters in a list of distinct entries
    entries: float = 20  # a shorter list is a line of tags
    distinct: float = 0.6  # share of the entries that are no repetition
    listed_function_words: float = 0.06

    def needed(self, n: int) -> float:
        """Share that must be covered in a text of n words: the less there is, the more."""
        return self.covered + self.few * 2 ** (-n / self.half)


def _values(tag: str) -> str:
    return " | " + " , ".join(next(g for g in m.groups()[1:] if g is not None) for m in VALUE.finditer(tag) if m[1].lower() not in STRUCTURE) + " | "


def _plain(text: str) -> str:
    """The text without hidden characters and markup, of which links, comments and what attributes say are kept."""
    t = text if text.isascii() else unicodedata.normalize("NFKC", text)
    if not t.isascii() or any(c in t for c in "*|~^"):
        t = HIDDEN.sub("", t)
    if "<" not in t:
        return t
    t = AUTOLINK.sub(r" | \1 | ", COMMENT.sub(r" | \1 | ", t))
    return TAG.sub(lambda m: _values(m[0]) if "=" in m[0] else " | ", t)


def autocorrelation(ids: np.ndarray) -> float:
    """The least share of equal terms among the lag windows that fit the sequence twice."""
    rates = []
    for lo, hi in WINDOWS:
        lags = [k for k in range(lo, hi + 1) if 2 * k <= len(ids)]
        if len(lags) == hi - lo + 1 or lags and not rates:
            rates.append(sum(int((ids[k:] == ids[:-k]).sum()) for k in lags) / sum(len(ids) - k for k in lags))
    return min(rates, default=0.0)


@lru_cache(maxsize=4096)
def _entry(gap: str) -> bool:
    return bool(ENTRY.match(gap))


def recurring(ids: np.ndarray, at: np.ndarray, least: int, gap: float, uneven: float) -> np.ndarray:
    """Which terms (``ids`` at the positions ``at``, ascending) come ``least`` times or more, at a mean gap of at most ``gap``
    and at gaps not much more uneven than chance, which makes their deviation as large as their mean."""
    by = np.argsort(ids, kind="stable")
    i, p = ids[by], at[by]
    begin = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
    count = np.diff(np.append(begin, len(i)))
    d = np.append(0, np.diff(p)).astype(float)
    d[begin] = 0
    sums, squares = np.add.reduceat(d, begin), np.add.reduceat(d * d, begin)
    gaps = np.maximum(count - 1, 1)
    mean = sums / gaps
    deviation = np.sqrt(np.maximum(squares / gaps - mean * mean, 0))
    good = (count >= least) & (mean <= gap) & (deviation <= uneven * mean)
    out = np.empty(len(ids), bool)
    out[by] = np.repeat(good, count)
    return out


def _links(t: str, begin: np.ndarray) -> np.ndarray | None:
    """The number of the link each word begins in, or -1; null where there is no link. A link has a scheme, www. or a path after its host."""
    found = [m.span() for m in URL.finditer(t)] if "://" in t or "www." in t.lower() else []
    last = 0
    for m in HOST_END.finditer(t):
        i = m.start()
        while i > last and (t[i - 1].isalnum() or t[i - 1] in "-."):
            i -= 1
        last = m.end()
        if i < m.start() and t[i - 1 : i] not in ("/", "@", "_"):
            found.append((i, m.end()))
    if not found:
        return None
    spans = np.array(sorted(found))
    k = np.searchsorted(spans[:, 0], begin, "right") - 1
    return np.where((k >= 0) & (np.maximum.accumulate(spans[:, 1])[np.maximum(k, 0)] > begin), k, -1)


def _list(t: str, points: np.ndarray, begins: np.ndarray, ends: np.ndarray, at: list, words: list[str], joined: np.ndarray, is_small: np.ndarray, number: np.ndarray, size: np.ndarray) -> tuple[int, float, int, float]:
    """Entries of lists within lines: their number, the share of distinct ones, their size, and the share of function words in them.

    An entry is a word or a few joined by spaces or hyphens, with the sign of a list on both sides (or on one, at the end of a list); lines of a table,
    which all have the same few fields, are none.
    """
    n = len(words)
    if joined.sum() > n - 4:
        return 0, 0.0, 0, 0.0
    edges = np.append(np.flatnonzero(~joined[:n]), n)  # first word of each entry
    left, right = ends[edges[1:-1] - 1], begins[edges[1:-1]]
    wide = right - left
    inside = SIGNS[np.minimum(points[np.minimum(left[:, None] + np.arange(4), len(points) - 1)], len(SIGNS) - 1)] * (np.arange(4) < wide[:, None])
    signs = (inside == 2).sum(1)
    between = (wide <= 4) & (inside > -1).all(1) & (signs <= 1) & ((signs == 1) | (inside == 3).any(1))
    breaks = np.append(0, np.cumsum(points == 10))
    inline = np.concatenate([[False], between, [False]])
    line = np.concatenate([[True], breaks[right] > breaks[left], [True]])
    long = np.diff(edges)
    isin = (inline[:-1] | inline[1:]) & (inline[:-1] | line[:-1]) & (inline[1:] | line[1:]) & (long <= 4)
    if isin.sum() < 2:
        return 0, 0.0, 0, 0.0
    row = np.cumsum(line[:-1])
    fields = np.bincount(row, isin)
    per_row = np.bincount(row)
    lists = (fields >= 4) & (fields == per_row)
    lists |= (fields >= 8) & (fields >= 0.8 * per_row)
    isin &= lists[row]
    chosen = np.flatnonzero(isin)
    chosen = chosen[[not number[edges[k] : edges[k + 1]].any() and "_" not in t[at[edges[k]][0] : at[edges[k + 1] - 1][1]] for k in chosen.tolist()]] if len(chosen) else chosen
    if not len(chosen):
        return 0, 0.0, 0, 0.0
    sizes = np.add.reduceat(size, edges[:-1])[chosen]
    small = np.add.reduceat(is_small.astype(int), edges[:-1])[chosen]
    names = {" ".join(words[edges[k] : edges[k + 1]]) for k in chosen.tolist()}
    return len(chosen), len(names) / len(chosen), int(sizes.sum()), float(small.sum() / long[chosen].sum())


def measure(text: str | None, rule: Rule = Rule(), every: bool = True) -> dict[str, float] | None:
    """The features of a text; null where it has fewer than two words, or, without ``every``, where those found first rule spam out."""
    t = _plain(text) if text else ""
    points, begins, ends = _words(t)
    n = len(begins)
    if n < 2:
        return None
    low, size = t.lower(), ends - begins
    at = list(zip(begins.tolist(), ends.tolist()))
    words = [low[a:b] for a, b in at] if len(low) == len(t) else [t[a:b].lower() for a, b in at]
    count = Counter(words)
    figures = {w for w in count if w.isdigit() and not (len(w) == 4 and w[:2] in ("19", "20"))}
    numbers = sum(count[w] for w in figures) / n
    if not every and numbers > rule.numbers:
        return None

    # Terms that recur at short gaps, more often the longer the text.
    often = int(2 + math.log2(1 + n / rule.more))
    hot = {w for w, c in count.items() if c >= often and not (w.isdigit() and len(w) != 4)}
    if n - 1 > rule.gap * (often - 1):  # else no gap can be longer
        last, first = dict(zip(words, range(n))), dict(zip(reversed(words), range(n - 1, -1, -1)))
        hot = {w for w in hot if (last[w] - first[w]) / (count[w] - 1) <= rule.gap}

    kinds = dict.fromkeys(count, 0)
    for bit, chosen_words in ((1, hot), (2, FUNCTION_WORDS & kinds.keys()), (4, figures), (8, [w for w, c in count.items() if c > 2])):
        for w in chosen_words:
            kinds[w] |= bit
    kind = np.fromiter(map(kinds.__getitem__, words), np.int8, n)
    is_hot, is_small, number = (kind & 1).astype(bool), (kind & 2).astype(bool), (kind & 4).astype(bool)
    gap, first_of, last_of = begins[1:] - ends[:-1], points[np.minimum(ends[:-1], len(points) - 1)], points[begins[1:] - 1]
    space = (gap == 1) & (first_of == 32) | (gap == 2) & (first_of == 32) & (last_of == 32)
    join = (gap == 0) | space | (gap == 1) & JOINS[np.minimum(first_of, 127)]
    join &= ~number[1:] & ~number[:-1]
    link = _links(t, begins) if "/" in low or "www." in low else None
    low_line = (gap == 1) & (first_of == 95)  # joins an identifier, and words only within a link
    if link is not None:
        join &= (link[1:] == link[:-1]) & (~low_line | (link[1:] >= 0))
    else:
        join &= ~low_line

    # Stretches of joined words, and in them three that come again.
    joined = np.zeros(n + 1, bool)
    joined[1:-1] = join
    edge = np.flatnonzero(joined[1:] != joined[:-1])
    begin, end = edge[::2], edge[1::2] + 1
    # Phrases of three words as terms of their own, by their recurrence gaps.
    again = np.zeros(n, bool)
    thrice = (kind & 8).astype(bool)  # words of which such a three can consist
    three = np.flatnonzero(joined[1:-2] & joined[2:-1] & thrice[:-2] & thrice[1:-1] & thrice[2:] & ((is_small[:-2].astype(int) + is_small[1:-1] + is_small[2:]) <= 1)) if n > 2 else []
    if len(three):
        number_of: dict[str, int] = {}
        code = np.zeros(n, np.int64)
        for i in np.unique(np.concatenate([three, three + 1, three + 2])).tolist():
            code[i] = number_of.setdefault(words[i], len(number_of))
        _, triple = np.unique((code[three] * len(number_of) + code[three + 1]) * len(number_of) + code[three + 2], return_inverse=True)
        three = three[recurring(triple, three, 3, rule.gap, rule.uneven)]
        for k in range(3):
            again[three + k] = True

    sums = np.zeros((4, n + 1), np.int64)
    np.cumsum([is_hot, is_small, size], axis=1, out=sums[:3, 1:])
    np.cumsum(space, out=sums[3, 1:-1])
    sums[3, -1] = sums[3, -2]
    hot_in, small_in, size_in = sums[:3, end] - sums[:3, begin]
    spaces_in = sums[3, end - 1] - sums[3, begin]
    length = end - begin
    share = small_in / length
    for k in np.flatnonzero(share > 0.25).tolist():
        if len(FUNCTION_WORDS.intersection(words[begin[k] : end[k]])) < 2:  # one function word again and again is a keyword like the others
            share[k] = 0.25
    in_sentences = int(size_in[share > 0.25].sum())
    is_phrase = (share <= 0.34) & (hot_in >= 0.66 * length)
    phrases, phrase_words = int(is_phrase.sum()), int(length[is_phrase].sum())
    phrase, listed = [], []  # positions
    for a, b, spaced in zip(begin[is_phrase].tolist(), end[is_phrase].tolist(), spaces_in[is_phrase].tolist()):
        phrase += range(a, b)
        if spaced or link is not None and link[a] >= 0 or at[a][0] and t[at[a][0] - 1] == "#":
            listed += range(a, b)
    alone = ~joined[1:] & ~joined[:-1] & is_hot
    for i in np.flatnonzero(alone[1:-1]).tolist():
        i += 1
        if _entry(t[at[i - 1][1] : at[i][0]]) and _entry(t[at[i][1] : at[i + 1][0]]):
            listed.append(i)

    total = int(size[~number].sum()) or 1
    chosen = again.copy()
    if link is not None:
        # A link is one with such a phrase where it holds it, or where the phrase is its text.
        is_term = again.copy()
        is_term[phrase] = True
        beside = np.flatnonzero((link[1:] != link[:-1]) & (is_term[1:] | is_term[:-1]))
        beside = [i for i in beside.tolist() if gap[i] <= 4 and "\n" not in t[at[i][1] : at[i + 1][0]]]
        own = lambda x: np.isin(link, np.unique([*link[x], *(link[i] for i in beside if x[i + 1]), *(link[i + 1] for i in beside if x[i])])) & (link >= 0)
        chosen |= own(again)
        again_size = int(size[chosen].sum())
        chosen |= own(is_term)
    else:
        again_size = int(size[chosen].sum())
    chosen[listed] = True
    covered = int(size[chosen & ~number].sum()) / total
    entries, distinct, entry_size, entry_small = _list(t, points, begins, ends, at, words, joined, is_small, number, size)
    if not every and covered < rule.needed(n) and (entry_size < rule.listed * total or entries < rule.entries):
        return None
    follow, followed = defaultdict(set), Counter()
    for x, y in compress(zip(words, words[1:]), join.tolist()):
        follow[x].add(y)
        followed[x] += 1
    terms = [words[i] for i in phrase]
    code: dict[str, int] = {}
    ids = np.array([code.setdefault(w, len(code)) for w in terms], np.int64)
    chance = float((np.bincount(ids) ** 2).sum() - len(ids)) / max(1, len(ids) * (len(ids) - 1)) if len(ids) else 0.0
    mixed = [min(1.0, len(follow[w]) / min(followed[w], 10)) for w in terms if followed[w] >= 2]
    return {
        "words": float(n),
        "covered": covered,
        "repeated": again_size / total,
        "regular": autocorrelation(ids),
        "chance": chance,
        "mixing": float(np.mean(mixed)) if mixed else 0.0,
        "phrase_length": phrase_words / phrases if phrases else 0.0,
        "sentences": in_sentences / total,
        "function_words": int(is_small.sum()) / n,
        "numbers": numbers,
        "entries": float(entries),
        "listed": entry_size / total,
        "distinct": distinct,
        "listed_function_words": entry_small,
    }


def is_spam(f: dict[str, float] | None, rule: Rule = Rule()) -> bool:
    if f is None or f["numbers"] > rule.numbers:
        return False
    if f["covered"] >= rule.needed(int(f["words"])):
        mixed = f["mixing"] - 2 * f["function_words"] - f["sentences"]
        limit = min(rule.regular, rule.shuffled * f["chance"]) if f["function_words"] <= rule.listed_function_words else rule.regular
        if mixed >= rule.mixing and f["regular"] >= limit and f["phrase_length"] >= rule.phrase_length and f["sentences"] <= rule.sentences:
            return True
        if f["repeated"] >= rule.repeated and f["function_words"] <= rule.repeated_function_words and f["numbers"] <= rule.repeated_numbers:
            return True
    return f["entries"] >= rule.entries and f["listed"] >= rule.listed and f["distinct"] >= rule.distinct and f["listed_function_words"] <= rule.listed_function_words and f["numbers"] <= rule.repeated_numbers


def scored(df: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """(key, the features, spam) of each row; whole texts are read. Null, empty and very short texts have null features and are no spam."""
    kind = dict(df.dtypes)[key]
    d = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def work(batches):
        for b in batches:
            rows = [measure(x, rule) for x in b["text"].to_pylist()]
            cols = [pa.array([None if f is None else f[c] for f in rows], pa.float64()) for c in FEATURES]
            yield pa.RecordBatch.from_arrays([b["key"], *cols, pa.array([is_spam(f, rule) for f in rows])], ["key", *FEATURES, "spam"])

    schema = f"key {kind}, " + ", ".join(f"{c} double" for c in FEATURES) + ", spam boolean"
    return d.mapInArrow(work, schema).withColumnRenamed("key", key)


def spam_documents(df: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """The ``key`` of each document that is spam; features are worked out as far as a text needs them."""
    kind = dict(df.dtypes)[key]

    def work(batches):
        for b in batches:
            spam = pa.array([is_spam(measure(x, rule, False), rule) for x in b["text"].to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([b["key"].filter(spam)], ["key"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(work, f"key {kind}").withColumnRenamed("key", key)
