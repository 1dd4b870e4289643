"""Content keys of persisted relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import without_space


def _le8(n: Column) -> Column:
    """Eight bytes, least first, of a length."""
    n = n.cast("bigint")
    hexes = [F.lpad(F.hex(F.shiftrightunsigned(n, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(8)]
    return F.unhex(F.concat(*hexes))


def content_key(*parts: Column) -> Column:
    """SHA-256 over the parts, each behind its length in bytes, so that boundaries can't shift."""
    pieces = [x for p in parts for x in (_le8(F.octet_length(p)), F.encode(p, "UTF-8"))]
    return F.sha2(reduce(lambda a, b: F.concat(a, b), pieces), 256)


def sentence_hash(c: Column) -> Column:
    return content_key(without_space(c))


def article_key(source: Column, id_: Column) -> Column:
    return F.concat(source, F.lit("/"), id_)


def speaker_key(engine: Column, voice: Column) -> Column:
    return F.concat(engine, F.lit(":"), voice)


def rate_key(rate: Column) -> Column:
    return F.format_string("%.3f", rate.cast("float"))


def audio_key(text: Column, engine: Column, voice: Column, rate: Column) -> Column:
    return content_key(text, engine, voice, rate_key(rate))


def asr_key(audio: Column, model: Column) -> Column:
    return content_key(audio, model)


def biased_key(audio: Column, model: Column, words: Column) -> Column:
    """Without words, the unbiased key: both share one cache."""
    return F.when(F.size(words) == 0, asr_key(audio, model)).otherwise(content_key(audio, model, F.array_join(words, "\x1f")))


def bias_prompt(words: Column) -> Column:
    return F.when(F.size(words) > 0, F.array_join(words, " "))


def words_per_minute(rate: Column) -> Column:
    """Speaking rate as an engine option; null, that is left out, at the normal rate."""
    r = rate.cast("float")
    return F.when(r != 1, F.round(180 * r.cast("double")).cast("int"))
