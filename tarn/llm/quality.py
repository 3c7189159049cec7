"""Text quality statistics: a hidden Markov model labels each line prose, list, table or junk.

Lines are described by a few yes-or-no observations, all counted over arrays of
characters. Given the state of a line they are taken as independent; states
follow each other with a probability of staying. The chances are learned by
the Baum-Welch algorithm on all texts, from stated ones that
give the states their meaning. The most likely sequence
of states of a document is found with the Viterbi algorithm, for all documents
of a batch at once, line after line.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm._text import BLANK, CTRL, DIGIT, HAN, LOWER, PUNCT, SYMBOL, UPPER, chunks, classes, code_points
from tarn.session import ship
from tarn.storage import Scratch

STATES = ("prose", "list", "table", "junk")

#: Where learning starts: the chance of each observation in a line of each state, in the order of STATES.
OBSERVATIONS = {
    "sentence": (0.65, 0.04, 0.02, 0.10),  # ends a sentence
    "clause": (0.70, 0.05, 0.08, 0.15),  # has a comma between clauses
    "common": (0.88, 0.07, 0.04, 0.06),  # function words
    "bullet": (0.02, 0.50, 0.02, 0.02),  # begins as an entry does
    "entries": (0.015, 0.35, 0.03, 0.01),  # several entries or a key and its value
    "cells": (0.005, 0.01, 0.90, 0.04),  # divided as a neighbouring line is
    "short": (0.25, 0.85, 0.40, 0.30),
    "long": (0.40, 0.02, 0.10, 0.30),
    "odd": (0.01, 0.01, 0.01, 0.92),  # characters no text of a person has
}
STAY = 0.90
#: Rounds of learning, and how many lines of a state the stated chances count for, as a share of all lines.
LEARNING_ROUNDS, PRIOR_SHARE = 10, 0.04
#: A document is a case if at least this share of its visible characters is not prose.
MAINLY = 0.5

#: Function characters and words (fixed values), of which prose has many and entries few.
COMMON_HAN = "的了在已由与是为而但若则被把从请说我们再所以其等及这该有就都也很没并或即于给让使将因此按需共约只还不个"
COMMON_WORDS = ("the", "of", "and", "to", "in", "is", "a", "that", "it", "for", "was", "on", "as", "are", "be", "by", "not", "had", "this", "which", "there", "we", "he", "who", "or", "an", "at", "from", "were", "but", "if", "has", "have", "our", "when", "so", "does", "than", "with", "while", "after", "before", "into", "its", "can", "until")

SENTENCE_END = "。！？"
CLOSERS = "”’」』）)\"'】]》"
BULLETS = "-*•·▪◦‣●○■□◆◇►–—+"


def _set(chars: str) -> np.ndarray:
    return np.array([ord(c) for c in chars], dtype=np.uint32)


_BREAKS = re.compile("[\n\r\u2028\x85]")


@lru_cache(maxsize=1)
def _rare() -> np.ndarray:
    """Han characters that are neither in GB 2312 nor among the frequent ones of Big5; private and replacement characters."""
    out = np.zeros(0x110000, dtype=bool)
    for cp in range(0x3400, 0xA000):
        c = chr(cp)
        try:
            c.encode("gb2312")
            continue
        except UnicodeEncodeError:
            pass
        try:
            if 0xA4 <= c.encode("big5")[0] <= 0xC6:
                continue
        except UnicodeEncodeError:
            pass
        out[cp] = True
    out[0xE000:0xF900] = True
    out[0xFFFD] = True
    return out


@lru_cache(maxsize=1)
def _packed_words() -> np.ndarray:
    return np.array(sorted(sum(ord(ch) << (8 * i) for i, ch in enumerate(w)) for w in COMMON_WORDS if len(w) <= 6), dtype=np.uint64)


def _line_table(texts: list[str]) -> dict[str, np.ndarray]:
    """Counts of every non-blank line of the texts, and the number of the text it belongs to."""
    cp, starts = code_points(texts)
    cls = classes()[cp]
    n = len(cp)
    brk = (cp == 10) | (cp == 13) | (cp == 0x2028) | (cp == 0x85)
    line = np.cumsum(brk) - brk
    m = int(line[-1]) + 1
    vis = (cls != BLANK) & (cls != CTRL) | (cp == 0xFFFD)
    count = lambda mask: np.bincount(line[mask], minlength=m)
    t: dict[str, np.ndarray] = {"visible": count(vis)}
    at = np.flatnonzero(vis)
    last, first = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
    last[line[at]] = at
    first[line[at[::-1]]] = at[::-1]
    text_of = np.zeros(m, dtype=np.int64)
    text_of[line[starts]] = 1
    t["text"] = np.cumsum(text_of) - 1
    same = np.empty(n, dtype=bool)
    same[:-1] = line[1:] == line[:-1]
    same[-1] = False
    nxt = np.append(cp[1:], 10)
    nxt_cls = np.append(cls[1:], BLANK)
    prv_cls = np.insert(cls[:-1], 0, BLANK)
    han, low, up, dig = cls == HAN, cls == LOWER, cls == UPPER, cls == DIGIT
    t["han"], t["digit"] = count(han), count(dig)
    ascii_ = cp < 128
    latin = (low | up) & (cp < 0x250)
    t["latin"] = count(latin)
    t["punct"], t["symbol"] = count(cls == PUNCT), count(cls == SYMBOL)
    full_stop = np.isin(cp, _set(SENTENCE_END)) | (np.isin(cp, _set(".?!")) & (nxt_cls == BLANK) & (np.isin(prv_cls, (LOWER, UPPER, DIGIT, HAN, PUNCT))))
    t["stops"] = count(full_stop)
    t["full_stops"] = count(np.isin(cp, _set(SENTENCE_END)))
    t["full_commas"] = count((cp == 0xFF0C) & same)
    t["clauses"] = count((cp == 0xFF0C) | ((cp == 44) & (nxt == 32)) | (cp == 0xFF1B))
    # the last mark of the line, behind closing brackets
    end = last.copy()
    for _ in range(2):
        closer = np.isin(cp[end], _set(CLOSERS)) & (end > first)
        end = np.where(closer, end - 1, end)
    t["ends"] = np.isin(cp[end], _set(SENTENCE_END + "….?!；;：:"))
    t["sentence_end"] = np.isin(cp[end], _set(SENTENCE_END + "….?!"))
    # runs of letters as words
    is_word = latin
    begin = is_word & ~np.insert(is_word[:-1], 0, False)
    finish = is_word & ~np.append(is_word[1:], False)
    b, e = np.flatnonzero(begin), np.flatnonzero(finish)
    length = e - b + 1
    t["words"] = np.bincount(line[b], minlength=m)
    packed = np.zeros(len(b), dtype=np.uint64)
    lower = np.where((cp >= 65) & (cp <= 90), cp + 32, cp).astype(np.uint64)
    short = length <= 6
    for i in range(6):
        use = short & (length > i)
        packed[use] |= (lower[b[use] + i] & np.uint64(0xFF)) << np.uint64(8 * i)
    hit = short & np.isin(packed, _packed_words())
    t["common_words"] = np.bincount(line[b[hit]], minlength=m)
    t["common_han"] = count(np.isin(cp, _set(COMMON_HAN)))
    # cells: bars, tabs, semicolons, commas without a blank behind them, runs of blanks
    space = (cp == 32) | (cp == 0x3000)
    gap = space & np.append(space[1:], False) & ~np.insert(space[:-1], 0, False) & (prv_cls != BLANK) & (np.arange(n) < last[line])
    inside = (np.arange(n) > first[line]) & (np.arange(n) < last[line])
    between_digits = (prv_cls == DIGIT) & (nxt_cls == DIGIT)
    bare_comma = (cp == 44) & ~((nxt_cls == BLANK) & same & (nxt == 32)) & ~between_digits | ((cp == 44) & between_digits)
    t["bars"] = count((cp == 0x7C) | (cp == 0x2502) | (cp == 0x2503))
    t["tabs"] = count((cp == 9))
    t["semicolons"] = count((cp == 59) & ~((nxt == 32) & same))
    t["commas"] = count(bare_comma)
    t["gaps"] = count(gap)
    slash = (cp == 47) & (prv_cls == BLANK) & (nxt_cls == BLANK) & inside
    t["joined"] = count(slash | (cp == 0x3001) | ((cp == 44) & (nxt == 32)))
    t["slashes"] = count(slash | (cp == 0x3001))
    # bullets
    f = cp[first]
    bullet = np.isin(f, _set(BULLETS)) & (t["visible"] > 1)
    after = np.minimum(first + 1, n - 1)
    dash_word = np.isin(f, _set("-–—+")) & (cls[after] != BLANK)
    box = (f == 0x5B) & np.isin(cp[np.minimum(first + 2, n - 1)], _set("]")) & np.isin(cp[after], _set(" xX✓√"))
    p = first.copy()
    opened = np.isin(f, _set("(（【["))
    p = np.where(opened, after, p)
    number = cls[p] == DIGIT
    q = p.copy()
    while True:  # to the end of the number
        more = (cls[q] == DIGIT) & (q < n - 1)
        if not more.any():
            break
        q = np.where(more, q + 1, q)
    dotted = number & (np.isin(cp[q], _set(".．、)）】]")) | (opened & np.isin(cp[q], _set(")）】]")))) & (line[q] == np.arange(m)) & (q < last)
    dotted &= ~((cp[q] == 46) & (cls[np.minimum(q + 1, n - 1)] == DIGIT) & ~_toc(cp, cls, q, n))
    t["bullet"] = (bullet & ~dash_word) | box | dotted | ((f >= 0x2460) & (f <= 0x24FF))
    dots = (cp == 46) & (nxt == 46) & np.append(nxt[1:] == 46, False)
    t["leaders"] = count(dots) >= 2
    # a short key, a colon, a value
    colon = ((cp == 0xFF1A) | ((cp == 58) & (nxt == 32))) & same
    c_at = np.full(m, -1, dtype=np.int64)
    ci = np.flatnonzero(colon)
    c_at[line[ci[::-1]]] = ci[::-1]
    t["key"] = (c_at > first) & (c_at - first <= 8) & (c_at < last)
    # oddities
    t["rare"] = count(_rare()[cp])
    accent = ((cp >= 0x80) & (cp < 0x250)) | ((cp >= 0x2010) & (cp <= 0x203A)) & (nxt >= 0x80) & (nxt < 0x250) | (cp == 0x20AC) | (cp == 0x2122) | (cp == 0x2DC) | (cp == 0x2C6)
    accent &= cp != 0xA0
    accent &= cp != 0xB7
    t["accents"] = count(accent)
    t["tags"] = count(np.isin(cp, _set("<>{}&=#")))
    lone = vis & (prv_cls == BLANK) & (nxt_cls == BLANK)
    t["lone"] = count(lone)
    plain_mark = np.isin(cp, _set("，。、；：？！“”‘’（）《》【】—…·,.;:?!'\"()-/|│[]"))
    t["marks"] = count(((cls == PUNCT) | (cls == SYMBOL)) & ~plain_mark)
    cons = low & ~np.isin(cp, _set("aeiouy")) & ascii_
    four = cons.copy()
    for k in (1, 2, 3):
        four[k:] &= cons[:-k]
    four[:3] = False
    t["harsh"] = count(four)
    run_ch = ascii_ & (low | up | dig | np.isin(cp, _set("+/=")))
    rb = np.flatnonzero(run_ch & ~np.insert(run_ch[:-1], 0, False))
    re_ = np.flatnonzero(run_ch & ~np.append(run_ch[1:], False))
    longest = np.zeros(m, dtype=np.int64)
    np.maximum.at(longest, line[rb], re_ - rb + 1)
    t["run"] = longest
    hexa = ascii_ & (dig | ((lower >= 97) & (lower <= 102)))
    pair = hexa & np.append(hexa[1:], False) & (prv_cls == BLANK) & np.append(nxt_cls[1:] == BLANK, False)
    t["hex"] = count(pair)
    # repetition: the greatest share of characters that are those a fixed step before
    chars = np.bincount(line, minlength=m)
    best = np.zeros(m, dtype=np.int64)
    for k in range(1, 17):
        eq = (cp[k:] == cp[:-k]) & (line[k:] == line[:-k])
        np.maximum(best, np.bincount(line[k:][eq], minlength=m), out=best)
    edges = np.append(np.flatnonzero(np.append(True, line[1:] != line[:-1])), n)
    _long_periods(texts, cp, edges, chars, best)
    t["period"] = np.where(chars > 12, best / np.maximum(chars - 1, 1), 0.0)
    t["again"] = _repeated_lines(texts, m)
    keep = t["visible"] > 0
    return {k: v[keep] for k, v in t.items()}


def _long_periods(texts: list[str], cp: np.ndarray, edges: np.ndarray, chars: np.ndarray, best: np.ndarray) -> None:
    """Raises ``best`` for lines that repeat a unit of more than 16 characters: the distance at which a stretch of the line comes again is tried as the period."""
    whole = "\n".join(texts) + "\n"
    for i in np.flatnonzero((chars >= 40) & (best * 25 <= chars * 18)).tolist():
        a, b = int(edges[i]), int(edges[i + 1])
        for at in (a, a + (b - a) // 3):
            k = whole.find(whole[at : at + 8], at + 1, b) - at
            if k > 16:
                best[i] = max(best[i], int((cp[a + k : b] == cp[a : b - k]).sum()))


def _repeated_lines(texts: list[str], m: int) -> np.ndarray:
    """For each line, whether it is the third or a later one of the same wording, over twelve characters long, in its text."""
    out = np.zeros(m, dtype=bool)
    at = 0
    for text in texts:
        lines = _BREAKS.split(text)
        if len(lines) > 2:
            seen: dict[str, int] = {}
            for j, x in enumerate(lines):
                x = x.strip()
                if len(x) > 12:
                    seen[x] = seen.get(x, 0) + 1
                    out[at + j] = seen[x] > 2
        at += len(lines)
    return out


def _toc(cp: np.ndarray, cls: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """Whether digits after the dot at q are a second number followed by a blank (``1.2 name``)."""
    r = np.minimum(q + 1, n - 1)
    for _ in range(2):
        r = np.where(cls[r] == DIGIT, np.minimum(r + 1, n - 1), r)
    return (cls[r] == BLANK) & (r > q + 1) & (cls[np.minimum(r + 1, n - 1)] != DIGIT)


def observations(t: dict[str, np.ndarray]) -> np.ndarray:
    """A row of observations for each line, in the order of OBSERVATIONS."""
    v = np.maximum(t["visible"], 1)
    text = t["text"]
    new = np.append(True, text[1:] != text[:-1])
    letters = t["han"] + t["latin"]
    wide = t["han"] * 2 + (v - t["han"])  # width as printed
    common = (t["common_han"] * 14 >= np.maximum(t["han"], 1)) & (t["common_han"] > 0) | (t["common_words"] * 6 >= np.maximum(t["words"], 1)) & (t["common_words"] > 1)
    # a dot may end an entry's number; the Chinese marks are in prose only, also where its lines are broken at a width
    sentence = (t["full_stops"] > 0) | (t["stops"] > 0) & (t["sentence_end"] | (v > 30))
    cells = np.zeros(len(v), dtype=bool)
    for k, least in (("bars", 2), ("tabs", 1), ("semicolons", 1), ("commas", 1), ("gaps", 1)):
        x = t[k]
        before = np.append(0, x[:-1]) * ~new
        behind = np.append(x[1:] * ~new[1:], 0)
        near = (before == x) | (behind == x)
        if k == "gaps":  # an empty cell takes a gap away
            near |= ((before >= least) & (np.abs(before - x) <= 2)) | ((behind >= least) & (np.abs(behind - x) <= 2))
            near &= x * 200 > v  # cells lie close, however wide the table
        cells |= (x >= least) & near & (t["stops"] * 40 <= v)
    entries = ((t["slashes"] >= 2) | ((t["joined"] >= 2) & (t["common_words"] == 0) & ~common)) & ~sentence & (t["clauses"] <= t["joined"])
    entries |= (t["key"] & ~t["sentence_end"] & (wide <= 90)) | t["leaders"]
    odd = (t["rare"] * 6 > np.maximum(letters, 6)) | (t["accents"] * 5 > v) | (t["tags"] * 14 > v) | ((t["marks"] * 5 > v) & (t["bars"] < 2)) | ((t["lone"] * 2 > v) & (v > 8))
    odd |= (t["harsh"] * 14 > np.maximum(t["latin"], 12)) & (t["latin"] * 2 > v) | (t["run"] >= 28) | ((t["hex"] >= 8) & (t["hex"] * 2 * 10 > v * 7)) | (t["period"] > 0.72) & (t["bars"] < 2) & (v > 12)
    odd |= t["again"] & (t["bars"] < 2) & (t["tabs"] == 0)
    cells &= ~odd
    return np.stack([sentence, (t["full_commas"] > 0) | (t["clauses"] > 0) & (common | sentence), common, t["bullet"], entries & ~odd, cells, wide <= 48, wide >= 110, odd], axis=1)


class Model:
    """Chances of observations (a row for each, a column for each state) and of staying in a state."""

    def __init__(self, chance: np.ndarray | None = None, stay: float = STAY):
        self.chance = np.array(list(OBSERVATIONS.values())) if chance is None else np.asarray(chance, dtype=np.float64).reshape(len(OBSERVATIONS), len(STATES))
        self.stay = float(stay)

    def score(self, obs: np.ndarray) -> np.ndarray:
        return obs @ np.log(self.chance) + (~obs) @ np.log(1 - self.chance)

    def steps(self) -> np.ndarray:
        k = len(STATES)
        t = np.full((k, k), (1 - self.stay) / (k - 1))
        np.fill_diagonal(t, self.stay)
        return np.log(t)


def _emissions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = Model()
    return np.log(m.chance), np.log(1 - m.chance), m.steps()


def _sum_log(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _runs(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of each text, longest first."""
    starts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    sizes = np.diff(np.append(starts, len(text)))
    order = np.argsort(-sizes, kind="stable")
    return starts[order], sizes[order]


def posteriors(score: np.ndarray, text: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, float]:
    """Chance of each state in each line, and the expected number of steps that stay, by the forward-backward algorithm over all texts at once."""
    starts, sizes = _runs(text)
    ahead, behind = score.copy(), np.zeros(score.shape)
    live = [int(np.searchsorted(-sizes, -i, side="left")) for i in range(int(sizes[0]))]
    for i in range(1, len(live)):
        at = starts[: live[i]] + i
        ahead[at] = score[at] + _sum_log(ahead[at - 1][:, :, None] + steps[None], 1)
    stayed = 0.0
    whole = np.zeros(len(text))  # the chance of each text, at its lines
    for k, (a, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
        whole[a : a + n] = _sum_log(ahead[a + n - 1][None], 1)[0]
    for i in range(len(live) - 1, 0, -1):
        at = starts[: live[i]] + i
        later = steps[None] + (score[at] + behind[at])[:, None, :]
        behind[at - 1] = _sum_log(later, 2)
        both = ahead[at - 1][:, :, None] + later - whole[at][:, None, None]
        stayed += float(np.exp(np.einsum("nkk->nk", both)).sum())
    return np.exp(ahead + behind - whole[:, None]), stayed


def patterns(obs: np.ndarray) -> np.ndarray:
    """The observations of each line as one number."""
    return (obs @ (1 << np.arange(len(OBSERVATIONS)))).astype(np.int16)


def expected(m: Model, lines: np.ndarray, sizes: np.ndarray, times: np.ndarray) -> np.ndarray:
    """What a round of learning needs of texts, as one array: for each pattern the expected number of its lines in each state,
    then the expected number of steps that stay. ``lines`` are the texts' patterns one after another, ``times`` how often each text occurs.

    The forward-backward algorithm over all texts at once, scaled line by line.
    """
    n = 1 << len(OBSERVATIONS)
    every = (np.arange(n)[:, None] >> np.arange(len(OBSERVATIONS)) & 1).astype(bool)
    chance = np.exp(m.score(every))[lines]
    move = (1 - m.stay) / (len(STATES) - 1)
    same = m.stay - move
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    live = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left")
    ahead, total = chance.copy(), np.empty(len(lines))
    for i in range(len(live)):
        at = starts[: live[i]] + i
        x = ahead[at] if i == 0 else (same * ahead[at - 1] + move) * chance[at]
        total[at] = x.sum(axis=1)
        ahead[at] = x / total[at][:, None]
    weight = np.repeat(times.astype(float), sizes)
    behind, stayed = np.ones(ahead.shape), 0.0
    for i in range(len(live) - 1, 0, -1):
        at = starts[: live[i]] + i
        later = chance[at] * behind[at] / total[at][:, None]
        stayed += m.stay * float((weight[at] * (ahead[at - 1] * later).sum(axis=1)).sum())
        behind[at - 1] = same * later + move * later.sum(axis=1)[:, None]
    p = ahead * behind * weight[:, None]
    return np.append(np.stack([np.bincount(lines, weights=p[:, k], minlength=n) for k in range(len(STATES))], axis=1).ravel(), stayed)


def better(sums: np.ndarray, moves: float, prior: float) -> Model:
    """The model of a round's expected numbers (``expected``) over all texts, which have ``moves`` steps from line to line."""
    n, first = 1 << len(OBSERVATIONS), Model()
    each = sums[:-1].reshape(n, len(STATES))
    every = (np.arange(n)[:, None] >> np.arange(len(OBSERVATIONS)) & 1).astype(float)
    seen = (every.T @ each + prior * first.chance) / (each.sum(axis=0) + prior)
    return Model(np.clip(seen, 0.002, 0.998), float(np.clip((sums[-1] + prior * STAY) / (moves + prior), 0.5, 0.99)))


def _lines(texts: list[str]) -> list[np.ndarray]:
    """Patterns of the lines of each text that has any."""
    out = []
    for a, b in chunks(texts):
        t = _line_table(texts[a:b])
        found = patterns(observations(t))
        if len(found):
            out += np.split(found, np.flatnonzero(np.diff(t["text"])) + 1)
    return out


def learn(texts: list[str], rounds: int = LEARNING_ROUNDS, prior: float | None = None) -> Model:
    """A model of the texts by Baum-Welch. The stated chances count as ``prior`` lines of each state (PRIOR_SHARE of all lines), so that states keep their meaning."""
    own = _lines(texts)
    if not own:
        return Model()
    lines, sizes = np.concatenate(own), np.array([len(x) for x in own])
    m = Model()
    for _ in range(rounds):
        m = better(expected(m, lines, sizes, np.ones(len(sizes))), len(lines) - len(sizes), PRIOR_SHARE * len(lines) if prior is None else prior)
    return m


def fit_model(df: DataFrame, text: str, scratch: Scratch | None = None, rounds: int = LEARNING_ROUNDS) -> Model:
    """``learn`` on all texts of ``df``. Texts are read once, for the patterns of their lines; texts of the same patterns count together.
    Of a round, each task gives one row of sums."""
    ship(df.sparkSession)
    scratch = scratch or Scratch(df.sparkSession, "quality")

    def read(batches):
        for pdf in batches:
            own = _lines([t or "" for t in pdf["_text"]])
            yield pd.DataFrame({"lines": [x.tobytes() for x in own]})

    seen = df.select(F.col(text).alias("_text")).mapInPandas(read, "lines binary")
    seen = scratch.cut(seen.groupBy("lines").agg(F.count("*").alias("times")), "lines")
    whole = seen.agg(F.sum(F.col("times") * F.length("lines") / 2).alias("lines"), F.sum("times").alias("texts")).first()
    m = Model()
    for _ in range(rounds if whole.texts else 0):

        def run(batches, m=m):
            sums = 0.0
            for pdf in batches:
                size = pdf["lines"].map(len).to_numpy() // 2
                for a, b in _pieces(size, 200_000):
                    sums += expected(m, np.frombuffer(b"".join(pdf["lines"].iloc[a:b]), dtype=np.int16), size[a:b], pdf["times"].to_numpy()[a:b])
            if np.ndim(sums):
                yield pd.DataFrame({"sums": [sums]})

        got = seen.mapInPandas(run, "sums array<double>").collect()  # a row of 2,049 sums for each task
        sums = np.array([math.fsum(x) for x in zip(*(r.sums for r in got), strict=True)])
        m = better(sums, whole.lines - whole.texts, PRIOR_SHARE * whole.lines)
        m = Model(np.round(m.chance, 9), round(m.stay, 9))  # as sums of doubles depend on their order
    scratch.drop(seen)
    return m


def _pieces(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` lines each."""
    start, n = 0, 0
    for i, x in enumerate(size.tolist()):
        if n and n + x > most:
            yield start, i
            start, n = i, 0
        n += x
    if start < len(size):
        yield start, len(size)


def viterbi(score: np.ndarray, text: np.ndarray, steps: np.ndarray | None = None) -> np.ndarray:
    """The most likely state of every line; ``text`` (ascending) tells lines of different texts apart."""
    trans = Model().steps() if steps is None else steps
    starts = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(starts, len(text)))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    best, back = score.copy(), np.zeros(score.shape, dtype=np.int8)
    for i in range(1, sizes[0] if len(sizes) else 0):
        live = np.searchsorted(-sizes, -i, side="left")  # texts with more than i lines
        at = starts[:live] + i
        through = best[at - 1][:, :, None] + trans[None, :, :]
        back[at] = through.argmax(axis=1)
        best[at] = score[at] + through.max(axis=1)
    out = np.zeros(len(text), dtype=np.int8)
    if len(sizes):
        ends = starts + sizes - 1
        out[ends] = best[ends].argmax(axis=1)
        for i in range(sizes[0] - 1, 0, -1):
            live = np.searchsorted(-sizes, -i, side="left")
            at = starts[:live] + i
            out[at - 1] = back[at, out[at]]
    return out


def describe(texts: list[str], model: Model | None = None) -> pd.DataFrame:
    """Statistics and label shares of each text, by the stated model if none is given."""
    model = model or Model()
    parts = []
    for a, b in chunks(texts):
        t = _line_table(texts[a:b])
        m = b - a
        obs = observations(t)
        state = viterbi(model.score(obs), t["text"], model.steps())
        sum_ = lambda w: np.bincount(t["text"], weights=w, minlength=m)  # noqa: B023, E731
        v = sum_(t["visible"].astype(float))
        lines = sum_(np.ones(len(state)))
        units = sum_((t["words"] + t["han"]).astype(float))
        part = pd.DataFrame({"n_lines": lines.astype(np.int64), "n_visible": v.astype(np.int64), "n_words": units.astype(np.int64)})
        div = lambda x, y: np.divide(x, y, out=np.full(m, np.nan), where=y > 0)  # noqa: B023, E731
        part["mean_word_length"] = div(sum_((t["latin"] + t["han"]).astype(float)), units)
        part["symbol_ratio"] = div(sum_((t["punct"] + t["symbol"]).astype(float)), v)
        part["punctuated_lines"] = div(sum_(t["ends"].astype(float)), lines)
        part["common_share"] = div(sum_((t["common_words"] + t["common_han"]).astype(float)), units)
        for k, name in enumerate(STATES):
            part[f"{name}_share"] = div(sum_(np.where(state == k, t["visible"], 0).astype(float)), v)
        parts.append(part)
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()


SCHEMA = "n_lines long, n_visible long, n_words long, mean_word_length double, symbol_ratio double, punctuated_lines double, common_share double, prose_share double, list_share double, table_share double, junk_share double"


def text_statistics(df: DataFrame, id_col: str, text: str, model: Model | None = None) -> DataFrame:
    """One row for each row of ``df``: its id, statistics of the whole text and the share of its characters in lines of each state.

    Lines are labelled by ``model`` (``fit_model``), or by the stated chances without one.
    Words are runs of Latin letters and single Chinese characters. A null,
    empty or blank text has counts of 0 and null shares. Rows are described one
    by one: repeats give repeats, other columns are ignored, an empty table
    gives an empty result.
    """
    ship(df.sparkSession)
    id_type = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def run(batches):
        for pdf in batches:
            texts = pdf["_text"].tolist()
            if texts:
                out = describe(texts, model)
                out.insert(0, "_id", pdf["_id"].to_numpy())
                yield out

    out = rows.mapInPandas(run, f"_id {id_type}, {SCHEMA}")
    nan = [F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes if c != "_id"]
    return out.select(F.col("_id").alias(id_col), *nan)


def kind() -> Column:
    """``list``, ``table`` or ``junk`` for statistics of a text that is mainly not prose, else null."""
    top = F.greatest("list_share", "table_share", "junk_share")
    which = F.when(F.col("junk_share") == top, "junk").when(F.col("table_share") == top, "table").otherwise("list")
    return F.when(1 - F.col("prose_share") >= MAINLY, which)

