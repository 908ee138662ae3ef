"""Settings of the chunkers, checked on the driver before a plan is built.

Fixed values, for equal results: the default sizes, delimiters and rules, the playground's sizes, and the messages.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from .tokenizers import WORD, TextTokenizer


def positive(name: str, value: int) -> None:
    if value <= 0:
        raise ValueError(f"{name}: Expected a value greater than 0, got {value}")


def overlap(size: int, value: int) -> None:
    if value < 0:
        raise ValueError(f"chunkOverlap: Expected a value greater than or equal to 0, got {value}")
    if value >= size:
        raise ValueError("chunkOverlap must be less than chunkSize")


def clamped(size: float, chunk_overlap: float) -> tuple[int, int]:
    """What a form's numbers become."""
    own = max(1, int(size // 1))
    return own, max(0, min(int(chunk_overlap // 1), own - 1))


@dataclass(frozen=True)
class FastConfig:
    chunk_size: int = 4096
    delimiters: tuple[str, ...] = ("\n", ".", "?")

    def __post_init__(self):
        positive("chunkSize", self.chunk_size)
        if not self.delimiters:
            raise ValueError("delimiters must not be empty")


@dataclass(frozen=True)
class TokenConfig:
    chunk_size: int = 2048
    chunk_overlap: int = 0
    tokenizer: TextTokenizer = WORD

    def __post_init__(self):
        positive("chunkSize", self.chunk_size)
        overlap(self.chunk_size, self.chunk_overlap)


@dataclass(frozen=True)
class SentenceConfig:
    chunk_size: int = 2048
    chunk_overlap: int = 0
    delimiters: tuple[str, ...] = (". ", "! ", "? ", "\n")
    include_delim: str | None = "prev"
    tokenizer: TextTokenizer = WORD

    def __post_init__(self):
        positive("chunkSize", self.chunk_size)
        overlap(self.chunk_size, self.chunk_overlap)
        if not self.delimiters:
            raise ValueError("delimiters must not be empty")
        if self.include_delim not in ("prev", "next", None):
            raise ValueError("includeDelim must be prev, next or null")


@dataclass(frozen=True)
class Rule:
    """Delimiters, or white space, or neither: windows of tokens."""

    delimiters: tuple[str, ...] = ()
    whitespace: bool = False
    include_delim: str = "prev"


@dataclass(frozen=True)
class RecursiveConfig:
    chunk_size: int = 2048
    min_characters: int = 24
    rules: tuple[Rule, ...] = field(default=(Rule(("\n\n",)), Rule(("\n",)), Rule(whitespace=True), Rule()))
    tokenizer: TextTokenizer = WORD

    def __post_init__(self):
        positive("chunkSize", self.chunk_size)
        positive("minCharactersPerChunk", self.min_characters)
        if not self.rules:
            raise ValueError("rules must not be empty")


@dataclass(frozen=True)
class TableConfig:
    chunk_size: int = 3
    mode: str = "row"
    format: str = "auto"
    tokenizer: TextTokenizer = WORD

    def __post_init__(self):
        positive("chunkSize", self.chunk_size)
        if self.mode not in ("row", "token") or self.format not in ("markdown", "html", "auto"):
            raise ValueError("mode must be row or token, format markdown, html or auto")


#: Sizes that the playground starts with; it counts words, as the chunkers by themselves do.
PLAYGROUND = {
    "fast": FastConfig(320, ("\n", ".", "?", "!")),
    "recursive": RecursiveConfig(720, 48),
    "sentence": SentenceConfig(180, 20),
    "table": TableConfig(),
    "token": TokenConfig(240, 24),
}
