"""Parameters of an index and of a search, with their defaults."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class BuildConfig:
    k1: float = 1.5
    b: float = 0.75
    delta: float = 0.0
    #: Terms in more than this share of the documents are left out; only from 10 documents on.
    stop_df: float = 0.4
    k_expand: int = 10
    threshold: float = 0.65
    title_weight: float = 2.0
    subword_weight: float = 0.4
    snippet_chars: int = 320
    spell_min_df: int = 2
    clean: bool = False
    #: Weight of co-occurrence edges against embedding edges; 0 leaves them out.
    corpus_weight: float = 0.0
    window: int = 5
    corpus_k: int = 5
    min_cooc: int = 3
    bigram_max_df: float = 0.1
    #: Path of a subword vocabulary; None takes plain words.
    tokenizer: str | None = None

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class SearchOptions:
    k: int = 10
    offset: int = 0
    alpha: float = 0.5
    bigram_weight: float = 0.25
    proximity_weight: float = 0.0
    qexp_weight: float = 0.0
    mmr_lambda: float | None = None
    prf: bool = False
    prf_k: int = 10
    prf_t: int = 10
    prf_alpha: float = 0.3
    #: (column of docs, ascending) in order of importance.
    tiers: tuple[tuple[str, bool], ...] = ()
    band: float = 0.10
    filters: tuple[dict, ...] = ()
    #: Fields that ``search_facets`` counts.
    facets: tuple[str, ...] = ()
    #: A tree ensemble that ranks the ``window`` best anew by their features.
    trees: dict | None = None
    dedup: bool = False
    phrase: bool = True
    features: bool = False
    correct: bool = False
    payload: bool = True
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not 1 <= self.k <= 200 or not 0 <= self.offset <= 10_000:
            raise ValueError("k must be from 1 to 200, offset from 0 to 10,000")

    @property
    def window(self) -> int:
        """Candidates that bonuses and rerankers look at."""
        return min(max(self.k + self.offset, 100), 10_000)
