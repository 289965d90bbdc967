"""Token-array functions (X08-X14, X21, W06) as native higher-order expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import latin1_bytes

# Special tokens and their ids, in id order.
SPECIAL_TOKENS = ["<pad>", "<s>", "</s>", "<unk>", "<|endoftext|>", "<|im_start|>", "<|im_end|>"]
PAD_ID, BOS_ID, EOS_ID, UNK_ID = 0, 1, 2, 3
N_SPECIAL = len(SPECIAL_TOKENS)
IGNORE_INDEX = -100
MIN_CHUNK_LENGTH = 128


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def byte_ids(col, offset: int = N_SPECIAL, limit: int | None = None) -> Column:
    """Byte vocabulary: one id per UTF-8 byte, ``id = offset + byte``.

    JVM-only: the bytes are reinterpreted as Latin-1 characters, split and
    mapped with ``ascii``; no per-row Python.  ``limit`` keeps only the
    first bytes, cut before the split (truncation never splits the rest).
    """
    b = latin1_bytes(col)
    if limit is not None:
        b = F.substring(b, 1, int(limit))
    return F.transform(F.split(b, "", -1), lambda ch: F.ascii(ch) + F.lit(offset))


def byte_id_count(col) -> Column:
    """Number of byte-vocabulary ids without materialising them."""
    return F.octet_length(_c(col))


def add_specials(ids, bos: int = BOS_ID, eos: int = EOS_ID) -> Column:
    """X08 single template: ``<s> A </s>``."""
    return F.concat(F.array(F.lit(bos)), _c(ids), F.array(F.lit(eos)))


def add_specials_pair(a, b, bos: int = BOS_ID, eos: int = EOS_ID) -> Column:
    """X08 pair template: ``<s> A </s> B </s>`` -> struct(ids, type_ids)."""
    a, b = _c(a), _c(b)
    ids = F.concat(F.array(F.lit(bos)), a, F.array(F.lit(eos)), b, F.array(F.lit(eos)))
    types = F.concat(F.array_repeat(F.lit(0), F.size(a) + 2), F.array_repeat(F.lit(1), F.size(b) + 1))
    return F.struct(ids.alias("input_ids"), types.alias("token_type_ids"))


def truncate_with_specials(ids, max_length: int, bos: int = BOS_ID, eos: int = EOS_ID) -> Column:
    """Truncate the content so that specials + content <= max_length."""
    keep = max(max_length - 2, 0)
    return F.concat(F.array(F.lit(bos)), F.slice(_c(ids), 1, keep), F.array(F.lit(eos)))


def pad_right(ids, length, pad: int = PAD_ID) -> Column:
    """Right-pad with ``pad`` up to ``length`` (no truncation)."""
    ln = length if isinstance(length, Column) else F.lit(length)
    c = _c(ids)
    return F.concat(c, F.array_repeat(F.lit(pad), F.greatest(ln - F.size(c), F.lit(0))))


def attention_mask(n_real, length=None) -> Column:
    """X11: ``n_real`` ones then zeros up to ``length`` (TINYINT)."""
    n = n_real if isinstance(n_real, Column) else F.lit(n_real)
    ones = F.array_repeat(F.lit(1).cast("tinyint"), n)
    if length is None:
        return ones
    ln = length if isinstance(length, Column) else F.lit(length)
    return F.concat(ones, F.array_repeat(F.lit(0).cast("tinyint"), F.greatest(ln - n, F.lit(0))))


def labels_from_ids(ids, pad: int = PAD_ID, ignore_pads: bool = True) -> Column:
    """labels = ids, with pads replaced by -100 when ``ignore_pads``."""
    c = _c(ids)
    if not ignore_pads:
        return c
    return F.transform(c, lambda x: F.when(x == pad, F.lit(IGNORE_INDEX)).otherwise(x))


def special_tokens_mask(ids, n_special: int = N_SPECIAL) -> Column:
    """1 for special ids, else 0."""
    return F.transform(_c(ids), lambda x: (x < n_special).cast("int"))


def append_eos_if_missing(ids, eos: int = EOS_ID) -> Column:
    """Append EOS unless the sequence already ends with it (empty stays empty)."""
    c = _c(ids)
    return (F.when(F.size(c) == 0, c)
            .when(F.element_at(c, -1) == eos, c)
            .otherwise(F.concat(c, F.array(F.lit(eos)))))


def shift_inputs(ids) -> Column:
    """Model inputs for next-token prediction (drop the last token)."""
    c = _c(ids)
    return F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))


def shift_labels(ids) -> Column:
    """Targets for next-token prediction (drop the first token)."""
    c = _c(ids)
    return F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))


def safe_exp(col) -> Column:
    """``exp`` saturating to +Infinity (Spark doubles already do)."""
    return F.exp(_c(col))
