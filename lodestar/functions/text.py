"""Text functions as Column expressions: everything here stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "一-鿿"
FNV_BASIS, FNV_PRIME, U32 = 2166136261, 16777619, 0xFFFFFFFF
# Contact patterns.
PHONE = r"(?<!\d)(?:\+?86[-\s]?)?(?:0\d{2,3}[-\s]?)?\d{7,8}(?!\d)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def text(c: Column | str) -> Column:
    """The column as a string, null as empty."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """White space (Unicode) off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def bigrams(c: Column) -> Column:
    """Neighbouring pairs of a string's characters; one or two characters are themselves."""
    return F.when(F.length(c) <= 2, F.array(c)).otherwise(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2))))


def tokenize(c: Column) -> Column:
    """Lower-cased ASCII words and CJK bigrams; bigrams bridge what separates two CJK characters unless it holds a word."""
    joined = F.regexp_replace(F.lower(c), f"(?<=[{CJK}])[^A-Za-z0-9_{CJK}]+(?=[{CJK}])", "")
    runs = F.regexp_extract_all(joined, F.lit(f"([A-Za-z0-9_]+|[{CJK}]+)"), F.lit(1))
    split = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{CJK}]{{3,}}$"), bigrams(r)).otherwise(F.array(r))))
    return F.when(joined.rlike(f"[{CJK}]{{3}}"), split).otherwise(runs)


def char_ngrams(c: Column, sizes: tuple[int, ...] = (2, 3, 4)) -> Column:
    """Character n-grams of the lower-cased text without white space; the text itself where it is too short for any."""
    low = F.regexp_replace(F.lower(c), r"(?U)\s+", "")
    of = lambda n: F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.substring(low, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    grams = F.flatten(F.array(*[of(n) for n in sizes]))
    return F.when(F.size(grams) > 0, grams).when(low != "", F.array(low)).otherwise(F.array().cast("array<string>"))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over code points."""
    step = lambda h, x: ((h.bitwiseXOR(F.ascii(x).cast("bigint"))) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(U32))
    return F.when(c == "", F.lit(FNV_BASIS).cast("bigint")).otherwise(F.aggregate(F.split(c, ""), F.lit(FNV_BASIS).cast("bigint"), lambda h, x: F.when(x == "", h).otherwise(step(h, x))))


def squeeze(c: Column) -> Column:
    """White-space runs as one blank, ends stripped."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def truncate(c: Column, limit: int = 700) -> Column:
    """Squeezed text cut to ``limit`` characters."""
    return F.substring(squeeze(c), 1, limit)


def contains_any(c: Column, tokens: tuple[str, ...] | list[str], fold: bool = False) -> Column:
    """Whether the text holds any of the tokens (``fold``: whatever the case)."""
    if not tokens:
        return F.lit(False)
    base = F.lower(c) if fold else c
    return reduce(lambda a, b: a | b, (base.contains(t.lower() if fold else t) for t in tokens))


def count_of(c: Column, tokens: tuple[str, ...]) -> Column:
    """How many of the tokens occur in the text."""
    return reduce(lambda a, b: a + b, (c.contains(t).cast("int") for t in tokens), F.lit(0))


def occurrences(c: Column, token: str) -> Column:
    """How often a token occurs, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(token), F.lit("")))) / len(token)).cast("int")


def deobfuscate_email(c: Column) -> Column:
    """Spelt-out at and dot become signs."""
    for pattern, sign in ((r"(?i)\s*\[\s*at\s*\]\s*", "@"), (r"(?i)\s+at\s+", "@"), (r"(?i)\s*\[\s*dot\s*\]\s*", "."), (r"(?i)\s+dot\s+", ".")):
        c = F.regexp_replace(c, pattern, sign)
    return c


def redact(c: Column) -> Column:
    """Phone numbers, then e-mail addresses, become ``***``."""
    return F.regexp_replace(F.regexp_replace(deobfuscate_email(c), PHONE, "***"), EMAIL, "***")


def name_parts(c: Column) -> Column:
    """Parts of a name field between separators, 2 to 30 characters long."""
    return F.filter(F.transform(F.split(c, r"[、,，;；/|\n\t ]"), strip), lambda p: F.length(p).between(2, 30))


def labelled_text(fields: dict[str, Column], fallback: Column, limit: int = 700) -> Column:
    """``label：value`` lines of the fields that are not empty, each cut to ``limit``; the fallback where all are."""
    lines = F.concat_ws("\n", *[F.when(text(v) != "", F.concat(F.lit(f"{k}："), truncate(text(v), limit))) for k, v in fields.items()])
    return F.when(lines != "", lines).otherwise(truncate(fallback, limit))


def sha_id(url: Column, body: Column) -> Column:
    """Identity of a page: 16 hex digits of sha1 over the url and the text's first 200 characters."""
    return F.substring(F.sha1(F.concat(url, F.substring(body, 1, 200))), 1, 16)


def raw_key(url: Column) -> Column:
    """File name under which a page's HTML is kept."""
    return F.concat(F.substring(F.sha1(url), 1, 16), F.lit(".html"))


def mojibake(c: Column) -> Column:
    """How many signs of a wrong decoding a text holds."""
    # Characters that wrong decodings leave.
    bad = ("�", "鍛", "瑙", "鐮", "绠", "瀛", "涓", "嗗", "俓n")
    return reduce(lambda a, b: a + b, (occurrences(c, t) for t in bad))


def decode_best(data: Column, charsets: tuple[str, ...] = ("UTF-8",)) -> Column:
    """Bytes decoded by the charset that leaves the fewest signs of damage, the first on ties.

    GB18030 and GBK need ``spark.sql.legacy.javaCharsets`` (Spark decodes only its own short list otherwise); malformed input needs
    ``spark.sql.legacy.codingErrorAction``, else it raises."""
    options = [F.struct(mojibake(F.decode(data, cs)).alias("bad"), F.lit(i).alias("i"), F.decode(data, cs).alias("t")) for i, cs in enumerate(charsets)]
    return F.array_min(F.array(*options))["t"]


def lines_of(c: Column) -> Column:
    """Stripped lines."""
    return F.transform(F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n"), strip)


def drop_consecutive(lines: Column) -> Column:
    """An array without elements equal to their predecessor."""
    return F.filter(lines, lambda x, i: (i == 0) | (x != F.get(lines, i - 1)))
