"""String functions.

All but NFKC are native Spark expressions and stay inside whole-stage
codegen.  NFKC has no Spark builtin, so it is an Arrow UDF.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's str.strip() removes (str.isspace()),
# as one regex character class usable by Java and RE2 alike.
PY_SPACE_CLASS = (
    r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
PY_STRIP_RE = f"^{PY_SPACE_CLASS}+|{PY_SPACE_CLASS}+\\z"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# The same set as characters, derived by rule: every code point Python
# considers whitespace (``str.strip()`` removes exactly these).
PY_SPACE_CHARS = "".join(ch for ch in map(chr, range(0x110000)) if ch.isspace())


def py_strip(col) -> Column:
    """Python ``str.strip()``.  Plain ``trim`` removes only spaces; with
    the explicit character set it touches only the two ends of the string
    (a regex would scan every character)."""
    return F.trim(_c(col), F.lit(PY_SPACE_CHARS))


def safe_str(col) -> Column:
    """``(v or "").strip()`` on a string column."""
    return py_strip(F.coalesce(_c(col).cast("string"), F.lit("")))


def nonblank(col) -> Column:
    """Stripped value, or NULL when it is empty (drop-in for ``if v:``)."""
    return F.nullif(safe_str(col), F.lit(""))


def md5_prefix(col, k: int = 16) -> Column:
    """First ``k`` hex digits of md5 of the UTF-8 string."""
    return F.substring(F.md5(_c(col).cast("string")), 1, k)


def _nfkc(v):
    if not isinstance(v, str) or v.isascii() or unicodedata.is_normalized("NFKC", v):
        return v
    return unicodedata.normalize("NFKC", v)


#: Texts that are Python strings at a time.
TEXTS_HELD = 128


def _mapped(texts: pa.Array, fn) -> pa.Array:
    """``fn`` over the texts, a few at a time; the others stay as Arrow."""
    parts = []
    for i in range(0, len(texts), TEXTS_HELD):
        some = texts.slice(i, TEXTS_HELD)
        before = some.to_pylist()
        after = [fn(v) for v in before]
        parts.append(some if after == before else pa.array(after, texts.type))
    return pa.concat_arrays(parts) if parts else texts


@F.arrow_udf(T.StringType())
def nfkc(s: pa.Array) -> pa.Array:
    """Unicode NFKC (Arrow batch UDF; Spark has no builtin)."""
    return _mapped(s, _nfkc)


@F.arrow_udf(T.StringType())
def nfkc_casefold(s: pa.Array) -> pa.Array:
    """X02 part 1: NFKC followed by case folding (``nmt_nfkc_cf``)."""
    return _mapped(s, lambda v: _nfkc(v).casefold() if isinstance(v, str) else v)


def sp_normalize(col, remove_extra_whitespaces: bool = True, add_dummy_prefix: bool = True) -> Column:
    """NFKC + casefold; every white space (new lines and tabs too) is a
    space, runs collapse and the ends are trimmed; optional leading space."""
    c = nfkc_casefold(_c(col))
    if remove_extra_whitespaces:
        c = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    else:
        c = F.regexp_replace(c, r"(?U)\s", " ")
    if add_dummy_prefix:
        c = F.when(c == "", c).otherwise(F.concat(F.lit(" "), c))
    return c


# The public GPT-2 pre-tokenisation pattern (contractions,
# letter runs, digit runs, other-symbol runs, whitespace).
PRETOKEN_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# ``(?U)``: ``\s`` is Unicode White_Space (NBSP, U+3000, …), as in the
# Unicode-aware regex engines byte-level tokenizers use.
PRETOKEN_REGEX = "(?U)" + PRETOKEN_PATTERN


def with_prefix_space(col) -> Column:
    """Byte-level ``add_prefix_space``: prepend a space unless the text is
    empty or already begins with an ASCII space."""
    c = _c(col)
    return F.when((c == "") | c.startswith(" "), c).otherwise(F.concat(F.lit(" "), c))


def pretokens(col, add_prefix_space: bool = True) -> Column:
    """Split text into pre-tokens (array<string>), in order."""
    c = with_prefix_space(col) if add_prefix_space else _c(col)
    return F.regexp_extract_all(c, F.lit(PRETOKEN_REGEX), 0)


def _byte_alphabet() -> tuple[str, str]:
    """The byte -> printable-character rule of byte-level BPE.

    Bytes that are printable Latin-1 map to themselves; the remaining
    bytes map, in increasing order, to U+0100, U+0101, ...
    """
    keep = list(range(ord("!"), ord("~") + 1)) + list(range(0xA1, 0xAC + 1)) + list(range(0xAE, 0xFF + 1))
    src, dst, extra = [], [], 0
    for b in range(256):
        src.append(chr(b))
        if b in keep:
            dst.append(chr(b))
        else:
            dst.append(chr(256 + extra))
            extra += 1
    return "".join(src), "".join(dst)


BYTE_SRC, BYTE_DST = _byte_alphabet()
BYTE_ALPHABET = sorted(BYTE_DST)


def latin1_bytes(col) -> Column:
    """The UTF-8 bytes of a string as a string of Latin-1 characters (one per byte)."""
    return F.decode(F.encode(_c(col), "UTF-8"), "ISO-8859-1")


def byte_level(col) -> Column:
    """Map a string's UTF-8 bytes to the 256-symbol printable alphabet."""
    return F.translate(latin1_bytes(col), BYTE_SRC, BYTE_DST)


def byte_level_decode(col) -> Column:
    """Inverse of :func:`byte_level` (printable alphabet -> UTF-8 text)."""
    return F.decode(F.encode(F.translate(_c(col), BYTE_DST, BYTE_SRC), "ISO-8859-1"), "UTF-8")


def chars(col) -> Column:
    """Array of the characters (code points, not UTF-16 units) of a string."""
    return F.regexp_extract_all(_c(col), F.lit("(?s)."), 0)


SP_SPACE = "▁"  # the visible word-boundary mark of SentencePiece-style models


def sp_pretokens(col) -> Column:
    """SentencePiece-style pieces of normalised text: spaces become the
    boundary mark (attached to the next piece), digits split singly, letters
    (with their combining marks) split where the script changes, other
    symbols kept in runs.  Nothing of the text is lost."""
    t = F.translate(_c(col), " ", SP_SPACE)
    scripts = "|".join(f"(?:\\p{{Is{s}}}\\p{{M}}*)+" for s in
                       ("Han", "Hangul", "Hiragana", "Katakana", "Latin", "Cyrillic", "Greek", "Arabic"))
    pat = f"{SP_SPACE}?(?:\\p{{N}}|{scripts}|(?:\\p{{L}}\\p{{M}}*)+|[^\\p{{L}}\\p{{N}}{SP_SPACE}]+)|{SP_SPACE}"
    return F.regexp_extract_all(t, F.lit(pat), 0)


def byte_fallback(ch) -> Column:
    """``<0xNN>`` symbols of the UTF-8 bytes of a character (byte fallback)."""
    return F.transform(F.split(latin1_bytes(ch), "", -1),
                       lambda b: F.format_string("<0x%02X>", F.ascii(b)))
