"""Text functions as column expressions: everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Invisible characters that sanitising removes; tab, line feed and carriage return stay (fixed values).
DIRTY = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}\x{FEFF}\x{0000}-\x{0008}\x{000B}-\x{000C}\x{000E}-\x{001F}]"

#: Names and patterns of suspicious instructions, in the order they are reported (fixed values).
SUSPICIOUS = (
    ("ignore_instructions", r"(?i)ignore\s+(all\s+)?(previous|prior|above)\s+(instructions?|prompts?|rules?)"),
    ("disregard_instructions", r"(?i)disregard\s+(all\s+)?(previous|prior|above)"),
    ("role_override_en", r"(?i)you\s+are\s+now\s+(a|an|the)\b"),
    ("ignore_zh", r"忽略(以上|之前|前面|所有)(的)?(所有)?(指令|指示|提示|规则)"),
    ("disregard_zh", r"无视(以上|之前|前面|所有)"),
    ("new_instruction_zh", r"新的?(系统)?指令\s*[:：]"),
    ("system_prompt", r"(?i)system\s*prompt"),
    ("jailbreak_zh", r"越狱|开发者模式"),
)

#: Phrases of a refusal: those of the rule metrics, and two more for attribution (fixed values).
REFUSALS = ("无法回答", "资料未提及", "未提及", "未找到相关", "没有相关", "无法从", "不能回答", "无法确定", "不足以回答", "资料不足以", "无法根据")
REFUSALS_ATTRIBUTION = (*REFUSALS, "未包含", "未提供")

HAN = r"[\x{4e00}-\x{9fff}]"


def strip_dirty(c: Column) -> Column:
    """Text without invisible characters."""
    return F.regexp_replace(c, DIRTY, "")


def dirty_count(c: Column) -> Column:
    return F.length(c) - F.length(strip_dirty(c))


def suspicious_names(c: Column) -> Column:
    """Names of the suspicious patterns in a raw text, in their fixed order."""
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(n)) for n, p in SUSPICIOUS]))


def tokens(c: Column) -> Column:
    """Words: single Han characters and what stands between blanks; case and marks stay."""
    spaced = F.regexp_replace(F.coalesce(c, F.lit("")), f"({HAN})", " $1 ")
    return F.filter(F.split(spaced, r"\s+"), lambda t: t != "")


def sentences(c: Column) -> Column:
    """Sentences of each line, cut behind the marks 。！？!?；; — a dot is no end."""
    parts = F.flatten(F.transform(F.split(c, "\n"), lambda line: F.split(F.trim(line), r"(?<=[。！？!?；;])")))
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def marker_texts(c: Column) -> Column:
    """Citation marks of one to three digits, as written, in half or full width (the pattern is a fixed value)."""
    return F.regexp_extract_all(c, F.lit(r"(\[\d{1,3}\]|【\d{1,3}】)"), 1)


def marker_numbers(c: Column) -> Column:
    return F.transform(marker_texts(c), lambda m: F.regexp_replace(m, r"[\[\]【】]", "").cast("int"))


def ngrams(c: Column, n: int) -> Column:
    """Distinct character n-grams of the text without blanks; none if it is shorter than n. The text is split to characters once."""
    chars = F.filter(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""), ""), lambda x: x != "")
    shifted = [chars if j == 0 else F.slice(chars, j + 1, F.greatest(F.size(chars) - j, F.lit(0))) for j in range(n)]
    rows = F.slice(F.arrays_zip(*[s.alias(f"c{j}") for j, s in enumerate(shifted)]), 1, F.greatest(F.size(chars) - (n - 1), F.lit(0)))
    return F.array_distinct(F.transform(rows, lambda g: F.concat(*[g[f"c{j}"] for j in range(n)])))


def leak_ratio(question: Column, passage: Column, n: int = 5) -> Column:
    """Share of the question's n-grams that the passage has; 0 if it has none."""
    q, p = ngrams(question, n), ngrams(passage, n)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, p)) / F.size(q)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column, n: int = 3) -> Column:
    """Jaccard similarity of n-gram sets; 0 if either is empty."""
    x, y = ngrams(a, n), ngrams(b, n)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(F.lit(0.0))


def han_ratio(c: Column) -> Column:
    """Han characters among Han and ASCII letters; 0 if there are none of either."""
    h, a = F.regexp_count(c, F.lit(HAN)), F.regexp_count(c, F.lit("[A-Za-z]"))
    return F.when(h + a > 0, h / (h + a)).otherwise(F.lit(0.0))


def is_english(c: Column) -> Column:
    """Fewer than a tenth of the characters are Han."""
    return F.regexp_count(c, F.lit(HAN)) / F.greatest(F.length(c), F.lit(1)) < 0.1


def passage_is_rich(c: Column) -> Column:
    """At least 200 Han characters and Latin letters, and under a quarter digits."""
    letters = F.regexp_count(c, F.lit(HAN + "|[A-Za-z]"))
    return (letters >= 200) & (F.regexp_count(c, F.lit(r"[0-9]")) / F.greatest(F.length(c), F.lit(1)) < 0.25)


def question_norm(c: Column) -> Column:
    """A question without blanks and the usual marks, for exact comparison (the marks are fixed values)."""
    return F.regexp_replace(c, r"""[\s，。？！,.?!；;：:"'“”‘’（）()\[\]]""", "")


def contains_any(c: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(F.coalesce(c, F.lit("")), F.lit(p))
    return out


def refuses(answer: Column, attribution: bool = False) -> Column:
    return contains_any(answer, REFUSALS_ATTRIBUTION if attribution else REFUSALS)


def excerpt(c: Column, n: int = 800) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def doc_of(uid: Column) -> Column:
    """The document of a chunk id: what stands before its first colon."""
    return F.substring_index(uid, ":", 1)


def stem(path: Column) -> Column:
    """The file name without its folders and last ending."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def clean_html(c: Column) -> Column:
    """Title-free text of a page: scripts and styles out, blocks on lines of their own, tags off, the common entities decoded, blanks squeezed (the block tags are fixed values)."""
    t = F.regexp_replace(c, r"(?is)<script.*?</script>|<style.*?</style>", "")
    t = F.regexp_replace(t, r"(?i)</?(h[1-6]|p|li|ul|ol|div|br|tr|td|th|section|article)[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return squeeze(t)


def squeeze(c: Column) -> Column:
    t = F.regexp_replace(c, r"[ \t\r\f\x0B]+", " ")
    t = F.regexp_replace(t, r"\n[ \t]+", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def topic(title: Column, summary: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The first rule with a keyword in title or summary, in lower case; null if none has."""
    text = F.lower(F.concat_ws(" ", title, summary))
    return F.coalesce(*[F.when(F.greatest(*[F.contains(text, F.lit(w)).cast("int") for w in words], F.lit(0)) > 0, F.lit(name)) for name, words in rules], F.lit(None).cast("string"))


def url_id(url: Column, prefix: str = "web_") -> Column:
    """A document id of a page's address: digits joined by dashes in its last part, else the file's stem, else ten digits of its SHA-1."""
    number = F.regexp_extract(url, r"/(\d+-\d+)(?:\.html?)?$", 1)
    page = F.regexp_extract(url, r"/([^/?#]+)\.html?$", 1)
    return F.concat(F.lit(prefix), F.when(number != "", F.replace(number, F.lit("-"), F.lit("_"))).when(page != "", F.regexp_replace(page, r"[^a-zA-Z0-9_]+", "_")).otherwise(F.substring(F.sha1(url), 1, 10)))


def simhash(df: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    """Rows (key, fingerprint): 64 bits, each set if more n-grams of the text have it in their MD5 than not.

    The first 16 hex digits of a gram's MD5 are its vote, lowest bit first. Texts without
    n-grams get 0. Votes are summed within each task before the shuffle.
    """
    g = df.select(key, F.explode_outer(ngrams(F.col(text), n)).alias("_g")).withColumn("_m", F.md5("_g"))
    half = lambda a: F.conv(F.substring("_m", a, 8), 16, 10).cast("long")
    g = g.select(key, half(1).alias("_hi"), half(9).alias("_lo"))
    votes = [F.sum(F.when(F.shiftright(h, i).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1)).alias(f"b{32 * j + i}") for j, h in enumerate((F.col("_lo"), F.col("_hi"))) for i in range(32)]
    s = g.where("_hi is not null").groupBy(key).agg(*votes)
    bits = F.lit(0).cast("long")
    for i in range(64):
        bits = bits.bitwiseOR(F.when(F.col(f"b{i}") > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    got = s.select(key, bits.alias("fingerprint"))
    return df.select(key).distinct().join(got, key, "left").select(key, F.coalesce("fingerprint", F.lit(0).cast("long")).alias("fingerprint"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
