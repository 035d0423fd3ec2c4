"""Column roles and run settings."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TableSpec:
    """Roles of the columns of one input table.

    Column order used everywhere: text + numeric (+ categorical), then id, then label.
    """

    id: str
    label: str
    text: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()

    @property
    def data_columns(self) -> list[str]:
        return [*self.text, *self.numeric, *self.categorical]

    @property
    def columns(self) -> list[str]:
        return [*self.data_columns, self.id, self.label]


@dataclass
class SpotCheckSpec:
    """Settings of one spot-check run (what the reference keeps in its config module)."""

    table: TableSpec
    train: bool = True
    predict: bool = True
    test_size: float = 0.2
    seed: int = 42
    fold_seed: int = 1
    max_folds: int = 10
    metric: str = "accuracy"
    scalers: tuple[str, ...] = ("NOS", "STA", "MIX", "MAX")
    reductions: tuple[str, ...] = ("NOR",)
    algorithms: tuple[str, ...] = ("DUMY", "NCT", "GNB", "LRN")
    oversampler: str = "NOG"
    undersampler: str = "NUG"
    ngram_range: tuple[int, int] = (1, 1)
    max_df: float = 1.0
    stop_words: bool = False
    language: str | None = None
    encrypt_text: bool = False
    category_limit: int = 30
    categorize: bool = True
    data_limit: int | None = None
    mispredicted_top: int = 50
    extra: dict = field(default_factory=dict)
