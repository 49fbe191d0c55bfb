"""SQL spellings of the text expressions, for the checks (RE2 regular expressions, no look-around)."""

from __future__ import annotations

SPACE = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
HAN = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(c: str, pattern: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({c}, {lit(pattern)}, {to}, {lit(flags)})"


def trim_space(c: str) -> str:
    return sub(c, f"^[{SPACE}]+|[{SPACE}]+$", "''")


def normalize(c: str) -> str:
    c = sub(c, r"[\x{200B}-\x{200F}\x{FEFF}]", "''")
    c = sub(c, r"\r\n?", "chr(10)")
    c = sub(c, r"[ \t]+", "' '")
    c = sub(c, r"\n{3,}", "chr(10) || chr(10)")
    return trim_space(c)


def match_normalize(c: str) -> str:
    c = sub(c, f"[{SPACE}]+", "''")
    return f"lower(translate({c}, '，。！？：；\"“”''‘’', ',.!?:;'))"


def shingles(c: str) -> str:
    """Latin runs only: the driver's documents hold no Han text."""
    return f"regexp_extract_all({match_normalize(c)}, '[a-z0-9]+')"


def html_text(c: str) -> str:
    for tag in ("script", "style", "noscript"):
        c = sub(c, f"(?is)<{tag}.*?</{tag}>", "' '")
    c = sub(c, r"(?s)<!--.*?-->", "' '")
    c = sub(c, r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr|/section|/article)[^>]*>", "chr(10)")
    c = sub(c, r"<[^>]+>", "' '")
    for entity, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        c = f"replace({c}, {lit(entity)}, {lit(plain)})"
    c = sub(c, r"[ \t]+", "' '")
    c = sub(c, f"\\n[{SPACE}]*\\n[{SPACE}]*\\n+", "chr(10) || chr(10)")
    return trim_space(c)


def canonical(c: str) -> str:
    return sub(sub(c, r"[#?].*$", "''", ""), r"/$", "''", "")


def host(c: str) -> str:
    return f"lower(regexp_extract({c}, '://([^/?#]+)', 1))"


def estimate(c: str) -> str:
    n = f"length({sub(c, f'[^{HAN}]', chr(39) * 2)})"
    return f"CAST({n} + ceil((length({c}) - {n}) / 4.0) AS BIGINT)"


def token_hash(c: str) -> str:
    return f"('0x' || substr(md5({c}), 1, 16))::UBIGINT"
