"""Record types and options of the engine."""

from __future__ import annotations

from dataclasses import dataclass

TOKEN = "struct<surface:string,reading:string,pos:string>"
TOKENS = f"array<{TOKEN}>"
BLOCK = f"struct<tag:string,reference:{TOKENS},hypothesis:{TOKENS}>"
ARTICLE = "article_idx bigint, id string, source string, title string, url string, popularity bigint, body_kind string, body string, dedup boolean, trusted boolean"
REFS = "audio string, text string"
SEEN = "article string, sentence string"


@dataclass(frozen=True)
class NormalizeOptions:
    """Which differences between readings are folded."""

    dakuten: bool = True
    prolonged: bool = True
    sokuon: bool = True
    small: bool = True


LOOSE = NormalizeOptions()
STRICT = NormalizeOptions(False, False, False, False)


@dataclass(frozen=True)
class ExtractOptions:
    min_len: int = 20
    max_len: int = 80
    min_japanese_ratio: float = 0.5
    check_residue: bool = True
    max_per_article: int = 20


LENIENT = ExtractOptions(1, 2**31 - 1, 0.0, False, 2**31 - 1)


@dataclass(frozen=True)
class VoiceSpec:
    engine: str
    voice: str
    rate: float = 1.0
