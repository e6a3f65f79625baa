"""Text functions as Columns: cleaning, tokens, scores, highlights, languages, categories, summaries."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a CJK, kana or hangul character, and the marks that end a sentence.
CJK = "\\u4e00-\\u9fff"
KANA = "\\u3040-\\u309f\\u30a0-\\u30ff"
HANGUL = "\\uac00-\\ud7af"
SENTENCE_ENDS = "。！？.!?"
# Stop words of the content keyword extractor.
STOP_WORDS = ("的", "了", "在", "是", "和", "与", "为", "对", "中", "上", "下", "这", "那", "有", "可以", "需要", "使用", "进行", "通过", "能够")
# Stop words and blank-like marks of the cluster keyword extractor.
CLUSTER_STOP_WORDS = ("的", "了", "在", "是", "和", "与", "为", "对", "中", "上", "下", "这", "那")
CLUSTER_MARKS = "，。、"
# The words of the three rule categories.
RULE_CATEGORIES = {
    "技术": ("机器学习", "深度学习", "人工智能", "编程", "算法", "数据", "代码", "开发"),
    "商业": ("商业", "管理", "营销", "财务", "投资", "企业", "市场", "战略"),
    "教育": ("教育", "学习", "教学", "课程", "培训", "学校", "学生", "知识"),
}


def strip_all(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_markup(text: Column) -> Column:
    """Tags go, all but word characters and blanks become blanks, runs of blanks become one."""
    bare = F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", ""), r"(?U)[^\w\s]", " ")
    return strip_all(F.regexp_replace(bare, r"(?U)\s+", " "))


def clean_whitespace(text: Column) -> Column:
    """At most one empty line, single blanks, no other white space within lines, none at the ends."""
    out = F.regexp_replace(text, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r" {2,}", " ")
    return strip_all(F.regexp_replace(out, r"(?U)[^\S\n]+", " "))


def token_estimate(text: Column) -> Column:
    """Two tokens for three CJK characters, one for four others."""
    cjk = F.length(F.regexp_replace(text, f"[^{CJK}]", ""))
    return F.floor(cjk / F.lit(1.5) + (F.length(text) - cjk) / F.lit(4.0)).cast("int")


def word_tokens(text: Column) -> Column:
    """Lower-case words of Latin letters, digits and underscores; of each CJK run its pairs and then its characters."""
    low = F.lower(text)
    runs = F.regexp_extract_all(low, F.lit(f"[{CJK}]+"), F.lit(0))
    chars = lambda r: F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: r.substr(i, F.lit(1)))
    pairs = lambda r: F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: r.substr(i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    cjk = F.flatten(F.transform(runs, lambda r: F.concat(pairs(r), chars(r))))
    return F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0)), cjk)


_CJK_RUN = re.compile("[\u4e00-\u9fff]+")
#: Bytes of words as they are, all others as blanks.
_LATIN_WORD = bytes(x if x in b"abcdefghijklmnopqrstuvwxyz0123456789_" else 32 for x in range(256))


def tokens_of(text: str) -> list[str]:
    """`word_tokens` for one text in Python: where terms are counted within a row, which no expression does in one pass."""
    low = text.lower()
    try:
        return low.encode("latin-1").translate(_LATIN_WORD).decode("ascii").split()
    except UnicodeEncodeError:
        out = low.encode("ascii", "replace").translate(_LATIN_WORD).decode("ascii").split()
    for run in _CJK_RUN.findall(low):
        out += [a + b for a, b in zip(run, run[1:], strict=False)]
        out += run
    return out


def unicode_words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def blank_words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 0)


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text has; 0 for an empty query."""
    q = F.array_distinct(blank_words(query))
    n = F.size(q)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.try_divide(F.size(F.array_intersect(q, blank_words(text))).cast("double"), n.cast("double")))


def keyword_score(query: Column, title: Column, content: Column, title_weight: float = 0.6, content_weight: float = 0.4) -> Column:
    return title_weight * overlap(query, title) + content_weight * overlap(query, content)


def highlights(query: Column, title: Column, content: Column, most: int = 3) -> Column:
    """Up to `most` snippets: one of the title for each query word (10 characters around), then two of the content (20)."""

    def snippet(source: Column, at: Column, word: Column, around: int) -> Column:
        start = F.greatest(at - around, F.lit(1))
        return source.substr(start, at + F.length(word) + around - start)

    def places(source: Column, word: Column, around: int, most: int) -> Column:
        low = F.lower(source)
        first = F.instr(low, word)
        found = [first] if most == 1 else [first, F.when(first > 0, F.position(word, low, first + 1)).otherwise(F.lit(0))]
        return F.transform(F.filter(F.array(*found), lambda p: p > 0), lambda p: snippet(source, p, word, around))

    words = blank_words(query)
    return F.slice(F.concat(F.flatten(F.transform(words, lambda w: places(title, w, 10, 1))), F.flatten(F.transform(words, lambda w: places(content, w, 20, 2)))), 1, most)


def preview(text: Column, n: int = 200) -> Column:
    """The first n characters, with dots where there are more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def detect_language(text: Column) -> Column:
    """By script, in the order zh, ja, ko, en; Han text therefore counts as zh."""
    return F.when(text.rlike(f"[{CJK}]"), "zh").when(text.rlike(f"[{KANA}]"), "ja").when(text.rlike(f"[{HANGUL}]"), "ko").when(text.rlike("[a-zA-Z]"), "en").otherwise("unknown")


def normalize_for_language(text: Column, language: Column) -> Column:
    """Keeps what the language is written with: zh Han and word characters, ja also kana, en letters in lower case."""
    zh = F.regexp_replace(text, rf"(?U)[^{CJK}\w]", "")
    ja = F.regexp_replace(text, rf"(?U)[^{KANA}{CJK}\w]", "")
    en = F.regexp_replace(F.lower(text), r"[^a-zA-Z\s]", "")
    return strip_all(F.regexp_replace(F.when(language == "zh", zh).when(language == "ja", ja).when(language == "en", en).otherwise(text), r"(?U)\s+", " "))


def classify_by_rules(text: Column, categories: dict[str, tuple[str, ...]] | None = None, fallback: str | None = None) -> Column:
    """The category of which most words occur in the lower-cased text; ties go to the first.

    Without any hit the first category is given, or `fallback` where one is named.
    """
    rules = categories or RULE_CATEGORIES
    low = F.lower(text)
    scores = {name: sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0)) for name, words in rules.items()}
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    names = list(scores)
    out = F.lit(names[-1])
    for name in reversed(names[:-1]):
        out = F.when(scores[name] == best, F.lit(name)).otherwise(out)
    return out if fallback is None else F.when(best == 0, F.lit(fallback)).otherwise(out)


def sentences(text: Column) -> Column:
    """Non-blank stretches between sentence ends."""
    return F.filter(F.transform(F.split(text, f"[{SENTENCE_ENDS}]+"), strip_all), lambda s: F.length(s) > 0)


def summarize(text: Column, max_length: int = 200, most: int = 3) -> Column:
    """The first sentences, three at most, while they fit in max_length, each ended by a full stop; else a hard cut."""
    first = F.slice(sentences(text), 1, most)
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))
    grown = F.aggregate(
        first,
        start,
        lambda acc, s: F.when(~acc["full"] & (F.length(acc["out"]) + F.length(s) <= max_length), F.struct(F.concat(acc["out"], s, F.lit("。")).alias("out"), F.lit(False).alias("full"))).otherwise(F.struct(acc["out"].alias("out"), F.lit(True).alias("full"))),
        lambda acc: acc["out"],
    )
    return F.when(F.length(grown) > 0, grown).otherwise(preview(text, max_length))


def phrases(text: Column, width: int = 3) -> Column:
    """All runs of `width` words between white space, joined by blanks."""
    words = F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 0)
    shifted = [F.slice(words, k + 1, F.greatest(F.size(words) - (width - 1), F.lit(0))).alias(f"w{k}") for k in range(width)]
    return F.transform(F.arrays_zip(*shifted), lambda z: F.concat_ws(" ", *[z[f"w{k}"] for k in range(width)]))


def content_key(*parts: Column) -> Column:
    """MD5 of the parts joined by underscores; a key for caches and documents."""
    return F.md5(F.concat_ws("_", *parts))
