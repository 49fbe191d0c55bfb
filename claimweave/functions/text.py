"""Text expressions. All run inside the JVM; offsets and lengths are code points."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Character classes and punctuation folding that decide what counts as equal text.
HAN = "\u4e00-\u9fff\u3400-\u4dbf"
SPACE = r"\s" + "\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
ZERO_WIDTH = "\u200b-\u200f\ufeff"
FOLD_FROM = "，。！？：；"
FOLD_TO = ",.!?:;"
QUOTE_MARKS = "\"“”'‘’"
SENTENCE_END = r"。！？!?\n.;；"
EDGE_PUNCT = SPACE + r"。.，,！!？?：:；;、\"“”'‘’"
TOPICS = ["product", "gameplay", "monetization", "audience", "market", "brand", "creative", "performance", "other"]


def trim_space(c: Column) -> Column:
    """Trim every kind of Unicode blank, not only U+0020."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def normalize_text(c: Column) -> Column:
    """Storage form: no zero-width characters, LF line ends, squeezed blanks and blank lines."""
    c = F.regexp_replace(c, f"[{ZERO_WIDTH}]", "")
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return trim_space(c)


def match_normalize(c: Column) -> Column:
    """Comparison form: no blanks, no quote marks, full-width stops folded, lower case."""
    c = F.regexp_replace(c, f"[{SPACE}]+", "")
    return F.lower(F.translate(c, FOLD_FROM + QUOTE_MARKS, FOLD_TO))


def trim_edges(c: Column) -> Column:
    """Quote without surrounding blanks and punctuation."""
    return F.regexp_replace(c, f"^[{EDGE_PUNCT}]+|[{EDGE_PUNCT}]+$", "")


def has_han(c: Column) -> Column:
    return c.rlike(f"[{HAN}]")


def _none() -> Column:
    return F.array().cast("array<string>")


def shingles(c: Column) -> Column:
    """Latin/digit runs followed by overlapping Han bigrams (a lone Han character is kept)."""
    norm = match_normalize(c)
    han = F.regexp_replace(norm, f"[^{HAN}]+", "")
    # a zero-width look-ahead yields every overlapping pair in one linear pass
    pairs = F.when(F.length(han) == 1, F.array(han)).otherwise(
        F.regexp_extract_all(han, F.lit("(?=(..))"), F.lit(1))
    )
    return F.concat(
        F.regexp_extract_all(norm, F.lit("[a-z0-9]+"), F.lit(0)), F.when(has_han(c), pairs).otherwise(_none())
    )


def search_terms(c: Column) -> Column:
    """Index terms: lower-case words outside Han, contiguous Han bigrams, lone Han characters."""
    low = F.lower(c)
    words = F.regexp_extract_all(low, F.lit(rf"[\p{{L}}\p{{N}}&&[^{HAN}]]+"), F.lit(0))
    pairs = F.regexp_extract_all(low, F.lit(f"(?=([{HAN}]{{2}}))"), F.lit(1))
    lone = F.regexp_extract_all(low, F.lit(f"(?<![{HAN}])[{HAN}](?![{HAN}])"), F.lit(0))
    return F.concat(words, F.when(has_han(c), F.concat(pairs, lone)).otherwise(_none()))


def token_hash(c: Column) -> Column:
    """Signed 64-bit value of the first 16 hex digits of md5 (the same number in any SQL engine)."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 16), 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays taken as sets; two empty sets are equal, one empty set matches nothing."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(inter / F.greatest(union, F.lit(1)))


def estimate_tokens(c: Column) -> Column:
    han = F.length(F.regexp_replace(c, f"[^{HAN}]+", ""))
    return (han + F.ceil((F.length(c) - han) / 4)).cast("long")


def sentence_with(c: Column, pattern: str, longest: int | None = 200) -> Column:
    """Sentence holding the first match of the pattern, at most ``longest`` characters (None: all), trimmed.

    Grown outward from the match, so the text is read once whatever its length.
    """
    at = F.instr(c, F.regexp_extract(c, pattern, 0))
    head = F.reverse(F.regexp_extract(F.reverse(F.substring(c, F.lit(1), at - 1)), f"^[^{SENTENCE_END}]*", 0))
    tail = F.regexp_extract(F.substring(c, at, F.length(c)), f"^[^{SENTENCE_END}]*[{SENTENCE_END}]?", 0)
    whole = F.concat(head, tail)
    return trim_space(whole if longest is None else F.substring(whole, 1, longest))


def context_before(text: Column, start: Column, radius: int = 160) -> Column:
    lo = F.greatest(start - radius, F.lit(0))
    return F.substring(text, lo + 1, start - lo)


def context_after(text: Column, end: Column, radius: int = 160) -> Column:
    return F.substring(text, end + 1, F.lit(radius))


def fold_topic(c: Column) -> Column:
    return F.when(c.isin(TOPICS), c).otherwise(F.lit("other"))


def theme_topic(aspect: Column) -> Column:
    return (
        F.when(aspect == "monetization", F.lit("monetization"))
        .when(aspect.isin("story", "art", "audio"), F.lit("creative"))
        .otherwise(F.lit("gameplay"))
    )


def script_lang(c: Column) -> Column:
    """zh when any Han character shows, else en."""
    return F.when(c.rlike(r"[一-鿿]"), F.lit("zh")).otherwise(F.lit("en"))


def literal_pattern(c: Column) -> Column:
    """Regex that matches the value of a column literally."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
