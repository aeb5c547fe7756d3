"""Options of a law search, with the defaults that change results."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from gramlaw.functions.scores import OLDER_TYPE_BITS, TYPE_BITS


@dataclass(frozen=True)
class Options:
    seed: int = 42
    folds: int = 5
    n_proj: int = 24
    n_pairs: int = 24
    linear_lock: float = 0.95
    max_atoms: int = 36
    max_grammar: int = 12
    alpha: float = 1e-3
    rdmp_alpha: float = 1e-4
    rdmp_ols: bool = False
    criterion: str = "MDL"
    min_mse_gain: float = 1e-4
    dup_threshold: float = 0.995
    type_bits: dict = field(default_factory=lambda: dict(TYPE_BITS), hash=False)
    bit_weight: float = 1.25
    grammar_needs_both: bool = True
    try_perm_block: bool = False
    # greedy operator set
    ogset: bool = True
    max_ops: int | None = None
    bits_threshold: float | None = None
    ebic_gamma: float | None = None
    max_corr: float = 0.98
    bag_boots: int = 8
    bag_frac: float = 0.8
    bag_buckets: int = 10
    bag_exact: bool = False  # exactly max(4, ⌊bag_frac·n⌋) rows a bag, at about 2.6 times the work of buckets
    min_freq: float = 0.60
    final_min_freq: float = 0.60
    final_min_sign: float = 0.90
    final_min_bits: float = 6.0
    # expression-graph refiner
    refine: bool = True
    refine_depth: int = 6
    refine_proposals: int = 25
    refine_frontier: int = 24
    refine_keep: int = 24
    refine_tune: bool = True
    energy_loss: float = 1.0
    energy_order: float = 0.05
    energy_redundancy: float = 0.05
    energy_mdl: float = 1.0
    energy_flip: float = 0.02
    flip_inputs: tuple[int, ...] = ()

    def patched(self, **changes) -> "Options":
        return replace(self, **changes)


def older() -> Options:
    """Defaults of the earlier search: fewer atoms, OLS residualization, looser block acceptance, no operator set."""
    return Options(
        seed=1337,
        max_atoms=32,
        alpha=2e-3,
        rdmp_ols=True,
        type_bits=dict(OLDER_TYPE_BITS),
        bit_weight=1.0,
        grammar_needs_both=False,
        try_perm_block=True,
        ogset=False,
    )
