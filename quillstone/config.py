"""Parameters of the engine: chunker presets, search defaults, context presets."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class EngineConfig:
    enabled: bool = True
    query_expansion: bool = True
    hybrid: bool = True
    debug: bool = False
    push_source_types: bool = False
    push_context_filters: bool = False


@dataclass(frozen=True)
class WindowChunkConfig:
    """Overlapping sentence windows. max_chunks None lifts the ceiling; suffix_cascade False stops at the window that reaches the end."""

    max_chars: int = 900
    overlap_ratio: float = 0.15
    max_chunks: int | None = 400
    suffix_cascade: bool = True

    @property
    def overlap(self) -> int:
        return max(0, int(self.max_chars * max(0.0, min(0.5, self.overlap_ratio))))


@dataclass(frozen=True)
class SentenceChunkConfig:
    per_chunk: int = 4
    least: int = 2
    overlap: int = 1
    flashcards: int = 2
    quizzes: int = 1
    max_chars: int = 1000
    max_chunks: int = 60


# The presets of the sentence chunker.
SENTENCE_PRESETS = {
    "standard": SentenceChunkConfig(6, 2, 1, 3, 1, 1000, 80),
    "dense": SentenceChunkConfig(4, 2, 1, 2, 1, 700, 100),
    "balanced": SentenceChunkConfig(8, 3, 1, 4, 1, 1200, 60),
    "high_yield": SentenceChunkConfig(10, 4, 1, 4, 1, 1500, 50),
    "thorough": SentenceChunkConfig(6, 2, 1, 3, 1, 1000, 80),
}
#: A longer sentence is split at words; a shorter fragment is dropped.
LONGEST_SENTENCE, SHORTEST_SENTENCE = 500, 10


@dataclass(frozen=True)
class TokenChunkConfig:
    max_tokens: int = 500
    overlap_tokens: int = 60
    least_tokens: int = 120
    flashcards: int = 4


CHARS_PER_TOKEN = 4.0
# The presets of the token-budget chunker.
TOKEN_PRESETS = {
    "default": TokenChunkConfig(400, 50, 100, 4),
    "aggressive": TokenChunkConfig(350, 40, 80, 3),
    "foundation": TokenChunkConfig(500, 60, 120, 4),
    "medium": TokenChunkConfig(800, 100, 200, 6),
}


@dataclass(frozen=True)
class SearchConfig:
    top_k: int = 6
    min_score: float = 0.25
    expand: bool = True
    hybrid: bool = True

    @property
    def coarse(self) -> int:
        return max(50, 3 * self.top_k)

    @property
    def head(self) -> int:
        """Rows by embedding score that get a keyword score. No row beyond it can be among the coarse ones."""
        return max(self.coarse, 6 * self.top_k)


@dataclass(frozen=True)
class ContextConfig:
    max_chars: int = 600
    top_k: int = 3
    min_score: float = 0.35
    source_types: tuple[str, ...] | None = ("ai_note", "flashcard", "transcript")
    exclude_document: str | None = None
    attribution: bool = True

    def excluding(self, document: str) -> ContextConfig:
        return replace(self, exclude_document=document)


CONTEXT_PRESETS = {
    "standard": ContextConfig(),
    "minimal": ContextConfig(300, 2, 0.45, None, None, False),
    "rich": ContextConfig(900, 5, 0.30, None, None, True),
    "quiz": ContextConfig(500, 3, 0.40, ("ai_note", "flashcard", "quiz"), None, True),
}
# Fixed value: what a block of context begins with.
CONTEXT_HEADER = "RELATED KNOWLEDGE FROM YOUR STUDY HISTORY:\n"

# Labels of source types, and words with the two that replace them in expanded queries.
SOURCE_LABELS = {"ai_note": "Notes", "flashcard": "Flashcard", "quiz": "Quiz", "transcript": "Recording", "document": "Document", "slide_deck": "Slide_Deck"}
SYNONYMS = {
    "learn": ("study", "understand"),
    "study": ("learn", "review"),
    "explain": ("describe", "clarify"),
    "example": ("sample", "instance"),
    "concept": ("idea", "principle"),
    "define": ("explain", "describe"),
    "what": ("which", "how"),
    "why": ("reason", "cause"),
    "how": ("method", "process"),
    "summary": ("overview", "recap"),
    "detail": ("specific", "in-depth"),
    "key": ("important", "main"),
    "theory": ("concept", "principle"),
    "method": ("approach", "technique"),
    "result": ("outcome", "finding"),
    "analysis": ("examination", "study"),
}
MAX_EXPANSIONS = 4
SUPPORTED_LANGUAGES = ("en", "es", "de", "fr", "it", "pt", "zh-Hans", "ja")

# Frequent short words by which a text's language is told, for languages that part words by blanks.
FREQUENT_WORDS = {
    "en": ("the", "and", "of", "to", "that", "with", "for", "was", "this", "are"),
    "es": ("el", "los", "las", "que", "del", "una", "por", "con", "para", "y"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "mit", "von", "den", "ein"),
    "fr": ("le", "les", "des", "est", "une", "dans", "pour", "qui", "sur", "et"),
    "it": ("il", "gli", "della", "che", "di", "sono", "per", "nel", "alla", "anche"),
    "pt": ("os", "um", "uma", "não", "mais", "pelo", "são", "ao", "dos", "foi"),
}
