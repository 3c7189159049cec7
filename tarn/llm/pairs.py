"""Defects of question and answer pairs: noisy labelling functions joined by an expectation-maximization label model.

A labelling function is a column of 1 (defective), -1 (sound) or 0 (no opinion).
For each defect the functions' votes are counted by pattern, which is a handful
of rows however many pairs there are; expectation-maximization over the
patterns gives each function's habits in defective and sound pairs, the
defect's share and the posterior of each pattern.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.session import ship
from tarn.storage import Scratch

DEFECTS = ("empty", "copy", "language", "refusal", "truncated")

#: Longest and shortest endings looked up in the statistics of endings; a start is START characters.
ENDINGS = (8, 5, 3)
START = 3
#: An ending or start counts as known from this many sentences on.
KNOWN = 3
#: A start is one that sentences have if at least this share of its places, anywhere in the texts, begins a sentence that ends.
BEGINS = 1 / 6

# Phrases and marks that the labelling functions look for.
CITATION = r"\s*(\[\d{1,3}\]|【\d{1,3}】)"
PLACEHOLDER = ("na", "null", "none", "nil", "nan", "tbd", "todo", "undefined", "empty", "无", "空", "暂无", "待补充", "未填写", "无内容", "略", "答", "待定", "暂缺", "没有", "answer", "a")
LEAD_IN = r"(?i)^[\s*“”\"'`>#]*((as to|regarding|about) the question|you asked|your question( is| was)?|question|问题是|您问的是|你问的是|问题|关于|问|q)[\s:：“”\"']*"
GREETING = r"抱歉|对不起|很遗憾|不好意思|谢谢您的提问|您好|作为一个|经过检索|(?i)\bsorry\b|apologi[sz]e|i'?m afraid|unfortunately|as an assistant"
DECLINE = (
    r"无法(回答|作答|给出|提供|答复)|不能(对此|回答|作答|提供)|没法(给出|回答)|帮不上忙|恕我|恕难|不便(透露|猜测|回答)|不作答|不回答|答不了|不掌握|超出(我|了知识库|了我)|不支持此类|没有权限|不可以讲|给不了|"
    r"没有找到与|不足以回答|查不到.{0,24}记录|说不出结论|没有足够依据|没有可用的依据|都与此无关|并?未覆盖|没有写明|不处理|转人工|我无法确认|"
    r"(?i)\bi (cannot|can'?t|won'?t|will not|am unable|am not able|must decline|decline|don'?t know|do not know|have nothing|have no answer|would rather not)|unable to assist|outside what i|beyond my|do not let me|"
    r"no record of|not enough evidence|context is unrelated|do not say anything|none of the retrieved|no reply can|impossible for me|not able to help"
)
COURTESY = r"补充更多|换一种问法|带来不便|着急的心情|请谅解|建议联系|以免误导|(?i)rephrase|support desk|frustrating|adding more files|let you know"
PARTLY = r"资料未提及|资料没有说明|但无法确认具体"
DANGLING = r"(?i)(，并且|，而且|，由于|，因为|，但是|，所以|，其原因是|另外，由于|以及|、|，|,|：|:|；|;|—|-|（|\(|\[|【|“|「|《|\{|…|\.\.\.|[\[【]\d{0,3}|\s(and|or|the|a|an|of|to|because|because of|with|in|on|for|that|which|is|are|was|were)\s*)$"
TERMINAL = r"([。！？!?]|\.(?<!\.\.))[\s\"”’」』）)\]】*`_]*$"
ASKS_ENGLISH = r"(?i)英文|英语|in english|english,? please"
ASKS_CHINESE = r"(?i)中文|汉语|in chinese|chinese,? please"
STOP_EN = r"(?i)\b(the|of|and|to|in|is|that|it|for|was|on|as|are|be|by|not|this|which|there|we|from|were|while|before|after|had|has)\b"
STOP_OTHER = r"(?i)\b(le|la|les|des|du|une|est|et|dans|pour|que|qui|ne|pas|sera|el|los|las|una|es|por|con|se|del|al|y|der|die|das|und|ist|nicht|ein|eine|den|dem|mit|il|che|di|non|per|sono|os|uma|não|em|com)\b"


def _bare(c: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def normal(c: Column) -> Column:
    """For statistics: runs of digits as 9, names in Latin capitals as N, no citation marks or trailing blanks."""
    t = F.regexp_replace(c, CITATION, "")
    t = F.regexp_replace(t, r"\d[\d.,:\-]*\d|\d", "9")
    t = F.regexp_replace(t, r"\b[A-Z][A-Za-z]*[A-Z0-9][A-Za-z0-9\-]*9*\b", "N")
    return F.regexp_replace(t, r"[\p{Cf}\s\p{Z}]+$", "")


def _hash(cp: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    h = np.full(len(at), k, dtype=np.uint64)
    for j in range(k):
        h = h * np.uint64(1_000_003) + cp[at + j]
        h ^= h >> np.uint64(29)
    return h


def _counted(texts: list[str]) -> pd.DataFrame:
    """How often each ending-sized piece is followed by the end of a sentence, and how often by more text; how often each start begins a sentence."""
    joined = "\x00".join(texts) + "\x00"
    cp = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    n = len(cp)
    stop = np.isin(cp, np.array([ord(c) for c in "。！？!?\n"], dtype=np.uint64))
    nxt = np.append(cp[1:], 0)
    stop |= (cp == 46) & np.isin(nxt, np.array([32, 10, 0], dtype=np.uint64))
    gap = cp == 0
    start = np.zeros(n, dtype=bool)
    begun = True
    # a sentence starts behind an end, blanks and list marks skipped
    prev_stop = np.insert((stop | gap)[:-1], 0, True)
    blank = np.isin(cp, np.array([32, 10, 0x3000], dtype=np.uint64))
    start = prev_stop & ~blank & ~stop & ~gap
    after_blank = np.insert((prev_stop & blank)[:-1], 0, begun) & ~blank & ~stop & ~gap
    start |= after_blank
    out = []
    text = np.cumsum(gap) - gap
    for k in ENDINGS:
        at = np.arange(0, max(0, n - k))
        inside = text[at] == text[at + k - 1 + (at + k < n)]
        at = at[inside & ~gap[at + k]]  # what ends with its text tells nothing
        h = _hash(cp, at, k)
        end = stop[at + k]
        u, inv = np.unique(h, return_inverse=True)
        out.append(pd.DataFrame({"k": k, "h": u.view(np.int64), "n": np.bincount(inv), "e": np.bincount(inv, weights=end).astype(np.int64)}))
    # only sentences that end count as starts: otherwise broken ones would confirm themselves
    sid = np.cumsum(start)
    ended = np.bincount(sid, weights=stop & ~gap, minlength=int(sid[-1]) + 1 if n else 1) > 0
    at = np.flatnonzero(start)
    at = at[(at + START < n)]
    at = at[ended[sid[at]] & (text[at] == text[at + START - 1])]
    u, inv = np.unique(_hash(cp, at, START), return_inverse=True)
    out.append(pd.DataFrame({"k": 0, "h": u.view(np.int64), "n": np.bincount(inv, minlength=len(u)), "e": 0}))
    return pd.concat(out, ignore_index=True)


def _count_batches(batches):
    for pdf in batches:
        texts, part, size = pdf["_norm"].tolist(), [], 0
        for t in texts:
            part.append(t)
            size += len(t)
            if size > 1_000_000:
                yield _counted(part)
                part, size = [], 0
        if part:
            yield _counted(part)


def _look_up(batches):
    for pdf in batches:
        rows = []
        for key, frag in zip(pdf["_key"], pdf["_frag"], strict=True):
            cp = np.frombuffer(frag.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
            for k in ENDINGS:
                if len(cp) >= k:
                    rows.append((key, k, int(_hash(cp, np.array([len(cp) - k]), k).view(np.int64)[0]), False))
            if len(cp) >= START:
                h = int(_hash(cp, np.array([0]), START).view(np.int64)[0])
                rows += [(key, 0, h, True), (key, START, h, True)]  # START is one of ENDINGS: counted wherever it stands
        yield pd.DataFrame(rows, columns=["_key", "k", "h", "first"])


def last_piece(norm: Column) -> Column:
    """What follows the last end of a sentence, without list marks and lead-ins."""
    t = F.regexp_extract(norm, r"(?s)([^。！？!?\n]*)$", 1)
    t = F.regexp_replace(t, r"^(.*[A-Za-z0-9\)]\.\s+)", "")
    return F.regexp_replace(t, r"^\s*([\-*•·]|\d+[.、)])?\s*", "")


def sentence_ends(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """For unterminated answers: chance that their last piece is a whole sentence, and whether sentences start as it does.

    ``rows`` has _key, _norm (all texts, for the statistics) and _open. The
    longest ending that is known decides. Sentences start as a piece does if KNOWN of them do and
    they are the share BEGINS of all places of that start: a name that
    stands within sentences stays a name however often the table lets it begin one by chance.
    Result: _key, whole (null if none is known), begins.
    """
    ship(rows.sparkSession)
    stats = rows.select("_norm").mapInPandas(_count_batches, "k int, h long, n long, e long").groupBy("k", "h").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    open_ = rows.where("_open").select("_key", last_piece(F.col("_norm")).alias("_frag"))
    asked = open_.mapInPandas(_look_up, "_key long, k int, h long, first boolean")
    found = asked.join(stats, ["k", "h"], "left")
    known = F.when(~F.col("first") & (F.col("n") >= KNOWN), F.struct("k", (F.col("e") / F.col("n")).alias("p")))
    starts, places = F.max(F.when(F.col("k") == 0, F.col("n"))), F.max(F.when(F.col("first") & (F.col("k") > 0), F.col("n")))
    begins = (starts >= KNOWN) & (starts >= BEGINS * F.coalesce(places, F.lit(0)))
    return scratch.cut(found.groupBy("_key").agg(F.max(known)["p"].alias("whole"), F.coalesce(begins, F.lit(False)).alias("begins")), "ends")


#: What the languages of a text are told by, each counted once.
_COUNTED = {"han": r"[\x{4e00}-\x{9fff}]", "lower": r"\b[a-zà-ÿ']{2,}\b", "en": STOP_EN, "other": STOP_OTHER, "ko": r"[\x{ac00}-\x{d7a3}]", "ja": r"[\x{3041}-\x{30ff}]", "ru": r"[\x{0400}-\x{04ff}]", "far": r"[\x{0370}-\x{03ff}\x{0590}-\x{0dff}\x{0e00}-\x{0eff}]", "accent": r"[à-ÿ]"}


def _counts(c: Column, prefix: str) -> dict[str, Column]:
    return {f"{prefix}_{k}": F.regexp_count(c, F.lit(p)) for k, p in _COUNTED.items()}


def _language(prefix: str) -> Column:
    """zh, ja, ko, ru, en, other, or null where there is too little text to tell, from ``_counts``."""
    n = {k: F.col(f"{prefix}_{k}") for k in _COUNTED}
    return (
        F.when(n["ko"] >= 3, "ko")
        .when(n["ja"] >= 3, "ja")
        .when(n["ru"] >= 3, "ru")
        .when(n["far"] >= 3, "other")
        .when((n["han"] >= 4) | ((n["han"] >= 1) & (n["lower"] <= 1)), "zh")
        .when((n["lower"] >= 3) & (n["other"] + n["accent"] > n["en"]), "other")
        .when(n["lower"] >= 3, "en")
    )


def _vote(plus: Column, minus: Column) -> Column:
    return F.when(plus, F.lit(1)).when(minus, F.lit(-1)).otherwise(F.lit(0))


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of the table at a time as bits of one integer: exact for texts of any length."""
    if not b:
        return len(a)
    full, top = (1 << len(b)) - 1, len(b) - 1
    at: dict[str, int] = {}
    for i, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << i
    up, down, score = full, 0, len(b)
    for c in a:
        eq = at.get(c, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (full & ~(h | up)), up & h
        score += (plus >> top & 1) - (minus >> top & 1)
        plus, minus = plus << 1 | 1, minus << 1
        up = (minus | ~(v | plus)) & full
        down = plus & v & full
    return score


def _far(batches):
    for pdf in batches:
        yield pd.DataFrame({"_key": pdf["_key"], "_far": [edit_distance(a, q) for a, q in zip(pdf["c_led"], pdf["c_q"], strict=True)]})


#: Longer questions are compared in Python, which takes less time for them than the JVM; the distance is the same.
LONG = 2000


def prepared(df: DataFrame, question: Column, answer: Column) -> DataFrame:
    """``df`` with everything that labelling functions look at. Each step is a projection of its own, so that no expression is evaluated twice."""
    raw = F.coalesce(answer, F.lit(""))
    d = df.withColumns({"c_question": F.coalesce(question, F.lit("")), "c_raw": F.regexp_replace(F.regexp_replace(raw, CITATION, ""), r"[\p{Cf}]+", "")})
    d = d.withColumn("c_a", F.regexp_replace("c_raw", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    d = d.withColumns({"c_core": _bare(F.col("c_a")), "c_q": _bare(F.col("c_question")), "c_text": F.regexp_replace("c_a", LEAD_IN, "")})
    d = d.withColumns({"c_led": _bare(F.col("c_text")), "n": F.length("c_core"), "nq": F.length("c_q")})
    return d


def _measured(d: DataFrame) -> DataFrame:
    """The rest of ``prepared``, which needs ``_far``: the edit distance where the question is LONG, else null."""
    nq, n = F.col("nq"), F.col("n")
    near = (n <= nq * 3 / 2 + 8) & (nq >= 6)
    d = d.withColumns({
        "rest": F.when(nq >= 4, F.replace("c_led", "c_q", F.lit(""))).otherwise(F.col("c_led")),
        "led": F.length("c_led"),
        "distance": F.when(near & (nq <= LONG), F.levenshtein("c_led", "c_q")).when(near, F.col("_far")).otherwise(nq + 99),
        "c_body": F.when(nq >= 4, F.replace("c_text", "c_question", F.lit(""))).otherwise(F.col("c_text")),
    })
    # a quoted question in front of an answer is no part of it; the quotation is about as long as the question
    d = d.withColumn("c_quote", F.when(F.contains("c_core", F.col("c_q")) & (nq >= 6), F.regexp_extract("c_body", r"(?s)^(.*?[”\"][：:。.,，]?\s*)", 1)))
    within = F.length("c_quote") <= 2 * F.length("c_question") + 200
    d = d.withColumn("c_body", F.when(F.col("c_quote").isNull(), F.col("c_a")).when(within, F.substring("c_body", F.length("c_quote") + 1, F.length("c_body"))).otherwise(F.col("c_body")))
    d = d.withColumn("c_sentences", F.filter(F.split("c_body", r"(?<=[。！？])|\n|(?<=[.?!])\s"), lambda s: F.length(_bare(s)) > 1))
    d = d.withColumn("c_said", F.transform("c_sentences", lambda s: F.struct(s.rlike(DECLINE).alias("declines"), s.rlike(COURTESY).alias("courtesy"), s.rlike(PARTLY).alias("partly"))))
    opening = F.get("c_sentences", F.lit(0))
    d = d.withColumns({"sentences": F.size("c_said"), "opener": F.get("c_said", F.lit(0)), "greets": F.coalesce(opening.rlike(GREETING), F.lit(False)), "greets_at_all": F.col("c_body").rlike(GREETING)})
    asked_for = F.regexp_replace("c_question", r"(?i)(reply|answer) in (english|chinese),?( please)?\.?|（?请?用(中文|英文)(回答|作答)。?）?|（答案用.语给出）", "")
    d = d.withColumns(_counts(asked_for, "q") | _counts(F.col("c_a"), "a"))
    d = d.withColumns({"lang_q": _language("q"), "lang_a": _language("a"), "letters": F.length(F.regexp_replace("c_a", r"[^\p{L}]", "")), "small": F.regexp_count("c_a", F.lit(r"\p{Ll}{2,}|[\x{ac00}-\x{d7a3}\x{3041}-\x{30ff}\x{0400}-\x{04ff}]")), "c_end": F.regexp_replace("c_a", r"[*`_\s]+$", "")})
    q = F.col("c_question")
    return d.withColumns({
        "asked": (q.rlike(ASKS_ENGLISH) & (F.col("lang_a") == "en")) | (q.rlike(ASKS_CHINESE) & (F.col("lang_a") == "zh")),
        "placeholder": F.col("c_core").isin(*PLACEHOLDER),
        "terminal": F.col("c_a").rlike(TERMINAL),
        "dangling": F.col("c_end").rlike(DANGLING),
        "single": ~F.col("c_end").rlike(r"[。！？!?\n]|\.\s"),
        "value": F.regexp_extract("c_a", r"(?s)([^\n]*)$", 1).rlike(r"^[\-*•·\s]*[^，。,：:]{1,10}[：:]\s*[^，。]{1,40}$") & F.contains("c_a", F.lit("\n")),
    })


def labelling_functions() -> dict[str, dict[str, Column]]:
    """The votes for each defect, over the columns of ``prepared`` and those of ``sentence_ends`` (whole, begins)."""
    c = F.col
    n, nq, led, rest, distance = c("n"), c("nq"), c("led"), F.length("rest"), c("distance")
    has, size = n > 0, c("sentences")
    starts_so = (led * 2 >= nq) & (nq >= 6) & F.startswith("c_q", c("c_led"))
    declines = F.exists("c_said", lambda s: s["declines"] & ~s["partly"])
    all_idle = (size > 0) & ~F.exists("c_said", lambda s: ~s["declines"] & ~s["courtesy"])
    opens = F.coalesce(c("opener")["declines"], F.lit(False))
    lang_q, lang_a, asked = c("lang_q"), c("lang_a"), c("asked")
    differ, same = (lang_a != lang_q) & ~asked & ~c("placeholder"), (lang_a == lang_q) | asked
    han_share = F.try_divide(c("a_han").cast("double"), c("letters"))
    foreign = c("a_ko") + c("a_ja") + c("a_ru") + c("a_accent")
    whole, known, single, value, terminal = c("whole"), c("begins"), c("single"), c("value"), c("terminal")
    unfinished = has & ~terminal
    return {
        "empty": {
            "nothing": _vote(~has, n >= 5),
            "placeholder": _vote(c("placeholder") | ~has, has & ~c("placeholder")),
            "short": _vote(n <= 1, n >= 5),
        },
        "copy": {
            "remainder": _vote(has & (rest * 8 <= nq) & (led * 2 >= nq), (rest > 10) & (distance * 2 > nq)),
            "edit": _vote(has & ((distance * 5 <= nq) | starts_so), distance * 2 > nq),
            "whole": _vote(has & ((c("c_led") == c("c_q")) | (c("rest") == "") | starts_so), (c("c_led") != c("c_q")) & (rest > 4) & ~starts_so & (distance * 2 > nq)),
        },
        "language": {
            "script": _vote(differ, same),
            "letters": _vote((((lang_q == "zh") & (han_share < 0.05) & (c("small") >= 3)) | ((lang_q == "en") & (han_share > 0.3))) & ~asked, asked | ((lang_q == "zh") & (han_share > 0.2)) | ((lang_q == "en") & (han_share == 0) & (foreign == 0))),
            "foreign": _vote((foreign >= 1) & differ, (foreign == 0) & same),
        },
        "refusal": {
            "phrase": _vote(declines, ~declines & has),
            "opening": _vote(opens & ~c("opener")["partly"], (size > 0) & ~opens),
            "nothing_else": _vote(all_idle & declines, ~all_idle & (size > 0)),
            "greeting": _vote(c("greets") & declines, ~c("greets_at_all") & (n > 120)),
        },
        "truncated": {
            "dangling": _vote(has & c("dangling"), F.lit(False)),
            "terminal": _vote(has & ~terminal, terminal | ~has),
            "ending": _vote(unfinished & (whole < 0.4) & (known | ~single), ~terminal & (whole >= 0.4)),
            # a single piece that begins as no sentence does is a bare value, such as a name, a number or a date
            "start": _vote(unfinished & (known | ~single) & ~(F.coalesce(whole, F.lit(0.0)) >= 0.4) & ~value, ~terminal & ((single & ~known) | value) & ~c("dangling")),
        },
    }


def fit(patterns: dict[tuple[int, ...], float], rounds: int = 200, bounds: tuple[float, float] = (0.55, 0.995)) -> tuple[dict[tuple[int, ...], float], float]:
    """Posterior of each pattern of votes, and the defect's share, by expectation-maximization.

    Start: the mean vote decides. Each function has a rate of right votes among
    its votes on defective and on sound pairs; having no opinion tells nothing.
    Rates are kept within ``bounds``: no function may turn against its meaning,
    none alone is beyond doubt.
    """
    keys = list(patterns)
    if not keys:
        return {}, 0.0
    v = np.array(keys, dtype=int)
    c = np.array([patterns[k] for k in keys], dtype=float)
    m = v.shape[1]
    p = 1 / (1 + np.exp(2.0 - 3.0 * v.sum(axis=1)))
    share = 0.05
    for _ in range(rounds):
        z = np.full(len(keys), math.log(share / (1 - share)))
        for j in range(m):
            up, down = v[:, j] == 1, v[:, j] == -1
            bad, good = p * c, (1 - p) * c
            right = np.clip((bad[up].sum() + 4) / (bad[up | down].sum() + 5), *bounds)
            calm = np.clip((good[down].sum() + 4) / (good[up | down].sum() + 5), *bounds)
            z += np.where(up, math.log(right / (1 - calm)), 0) + np.where(down, math.log((1 - right) / calm), 0)
        new = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        share = float(np.clip(((new * c).sum() + 1) / (c.sum() + 20), 1e-6, 0.5))
        done = np.abs(new - p).max() < 1e-9
        p = new
        if done:
            break
    return dict(zip(keys, p.tolist(), strict=True)), share


def cutoff(posterior: dict[tuple[int, ...], float], held_out: dict[tuple[int, ...], float]) -> float:
    """The cutoff with the best expected F1 on held-out pairs, at least 1/2; ties to the lower, so that a pattern no held-out pair has is not left out."""
    rows = sorted(((posterior[k], n) for k, n in held_out.items() if k in posterior), reverse=True)
    total = sum(p * n for p, n in rows)
    best, at, hit, got = -1.0, 0.5, 0.0, 0.0
    for p, n in rows:
        if p < 0.5:
            break
        hit += p * n
        got += n
        f = 2 * hit / (got + total) if got + total else 0.0
        if f >= best - 1e-12:
            best, at = f, p
    return max(0.5, at - 1e-9)


def label_pairs(df: DataFrame, id_col: str, question: str, answer: str, scratch: Scratch) -> DataFrame:
    """Defects of pairs: rows (id, defect, posterior, main), several for a pair if several posteriors exceed their cutoffs.

    ``main`` marks the one with the greatest posterior (ties: in the order of
    DEFECTS). Functions' habits are learned on two thirds of the pairs, by a
    hash of the id, and cutoffs validated on the rest; the result covers all pairs. Pairs are one for each id:
    repeats count once, by the greatest row; null ids are left out. A null
    question is empty: such a pair can lack an answer or break off, but
    copy and language have nothing to compare with. Texts of any length are compared
    whole. An empty table gives an empty result.
    """
    spark = df.sparkSession
    one = df.select(F.col(id_col).alias("id"), F.col(question).alias("q"), F.col(answer).alias("a")).where("id is not null")
    one = one.groupBy("id").agg(F.max(F.struct(F.coalesce("a", F.lit("")).alias("a"), F.coalesce("q", F.lit("")).alias("q"))).alias("r"))
    trimmed = F.regexp_replace(F.regexp_replace(F.col("r.a"), r"\p{Cf}+", ""), r"[\s\p{Z}*`_]+$", "")
    rows = scratch.cut(one.select(F.xxhash64("id").alias("_key"), "id", F.col("r.q").alias("q"), F.col("r.a").alias("a"), normal(trimmed).alias("_norm"), (~F.regexp_replace(trimmed, CITATION, "").rlike(TERMINAL)).alias("_open")), "pairs")
    ends = sentence_ends(rows, scratch)
    full = prepared(rows.join(ends, "_key", "left").withColumn("begins", F.coalesce("begins", F.lit(False))), F.col("q"), F.col("a"))
    long_ones = rows.where(F.length("q") > LONG)
    if long_ones.isEmpty():
        full = full.withColumn("_far", F.lit(None).cast("int"))
    else:
        far = prepared(long_ones, F.col("q"), F.col("a")).where((F.col("nq") > LONG) & (F.col("n") <= F.col("nq") * 3 / 2 + 8))
        full = full.join(scratch.cut(far.select("_key", "c_led", "c_q").mapInPandas(_far, "_key long, _far int"), "far"), "_key", "left")
    votes = labelling_functions()
    voted = _measured(full).select("id", (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(3)) == 0).alias("held"), *[F.array(*v.values()).alias(d) for d, v in votes.items()])
    voted = scratch.cut(voted, "votes")
    long = voted.select("id", "held", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(d).alias("v")) for d in votes])).alias("x")).select("id", "held", "x.d", "x.v")
    counts = long.groupBy("held", "d", "v").agg(F.count("*").alias("n")).collect()  # at most 3 ** functions rows for a defect
    table = []
    for d in votes:
        fitted = {tuple(r.v): 0.0 for r in counts if r.d == d}
        held = dict(fitted)
        for r in counts:
            if r.d == d:
                (held if r.held else fitted)[tuple(r.v)] += r.n
        posterior, _ = fit(fitted)
        at = cutoff(posterior, held)
        table += [(d, list(k), float(p)) for k, p in posterior.items() if p >= at]
    won = spark.createDataFrame(table, "d string, v array<int>, p double")
    hits = long.drop("held").join(F.broadcast(won), ["d", "v"])  # at most 3 ** functions patterns of a defect
    order = F.element_at(F.create_map(*[F.lit(x) for i, d in enumerate(DEFECTS) for x in (d, -i)]), F.col("d"))
    per = hits.groupBy("id").agg(F.collect_list(F.struct(F.round("p", 6).alias("p"), order.alias("o"), F.col("d").alias("defect"), F.col("p").alias("posterior"))).alias("all"))  # at most five
    out = per.select("id", F.array_max("all")["defect"].alias("_main"), F.explode("all").alias("x"))
    return out.select("id", "x.defect", "x.posterior", (F.col("x.defect") == F.col("_main")).alias("main"))
