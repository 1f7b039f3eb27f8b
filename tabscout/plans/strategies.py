"""Training strategies: which samples each one needs."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tabscout.operators import samples


@dataclass(frozen=True)
class Strategy:
    """Sample settings of a strategy; optimiser settings belong to the trainer."""

    name: str
    loss: str
    supervision: str
    views: tuple[str, ...] = ("full",)
    base_model: str = "all-mpnet-base-v2"
    batch_size: int = 16
    epochs: int = 50
    patience: int = 5
    row_limit: int = 3
    seed: int = 42
    target_triplets: int = 10_000
    extra: dict = field(default_factory=dict)


# fixed values
STRATEGIES = {s.name: s for s in [
    Strategy("PC", "CosineSimilarityLoss", "supervised", views=("row",)),
    Strategy("SS-C", "MultipleNegativesRankingLoss", "self-supervised"),
    Strategy("TC", "TripletLoss", "supervised"),
    Strategy("TC-Opt", "TripletLoss", "supervised", views=("full", "schema")),
    Strategy("TC-SB", "TripletLoss", "supervised"),
    Strategy("MLM", "MLM", "self-supervised", base_model="microsoft/mpnet-base",
             extra={"max_seq_length": 512, "mlm_probability": 0.15}),
    Strategy("Hybrid", "Hybrid_MLM_then_TripletLoss", "hybrid", views=("full", "schema")),
]}


def build_samples(corpus: DataFrame, strategy: str, **options) -> dict[str, DataFrame]:
    """The sample tables of a strategy by stage. ``corpus`` should be a stored table."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {sorted(STRATEGIES)}")
    s = STRATEGIES[strategy]
    target = options.get("target_triplets", s.target_triplets)
    if s.name == "PC":
        listed = options.get("listed")  # pairs whose texts are wanted; all of them would be quadratic
        made = {"pairs": samples.pairs(corpus, s.seed)}
        return made if listed is None else {**made, "texts": samples.pair_texts(corpus, listed, s.views[0])}
    if s.name == "SS-C":
        return {"pairs": samples.self_pairs(corpus, s.views[0])}
    texts = {"texts": samples.plain_texts(corpus, "full")}
    if s.name == "MLM":
        return texts
    if s.name in ("TC-Opt", "Hybrid"):
        ids = samples.triplets(corpus, target, s.seed, fk_positives=False, views=list(s.views))
        made = {"triplets": samples.triplet_texts(corpus, ids)}
        return {**texts, **made} if s.name == "Hybrid" else made
    ids = samples.triplets(corpus, target, s.seed, fk_positives=s.name == "TC")
    made = samples.triplet_texts(corpus, ids)
    return {"triplets": samples.smart_batches(made, s.batch_size) if s.name == "TC-SB" else made}
