"""The search ladder: which parts a configuration's plan has."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keymoment.operators import fusion, search, temporal


@dataclass(frozen=True)
class Config:
    """What a configuration adds: a second language's vector, temporal neighbours, text and speech, answers of questions,
    alignment of sequences. Translation, decomposition and speech grounding change what queries come with, not the plan."""

    dual: bool = False
    neighbour: bool = False
    lexical: tuple[str, ...] = ()
    answers: bool = False
    alignment: bool = False

    @property
    def pool(self) -> int | None:
        """Candidates that are scored; None for as many as are asked for."""
        return 200 if self.neighbour or self.lexical else None


LADDER = {"a0": Config(), "a1": Config(True), "a2": Config(True, True), "a3": Config(True, True, ("ocr", "asr")), "a4": Config(True, True, ("ocr", "asr"), True)}
LADDER |= {name: Config(True, True, ("ocr", "asr"), True, True) for name in ("a5", "a6", "a6_1", "a6_2", "a6_4", "a7")}


def run_ladder(frames: DataFrame, query: list[float], config: Config, support: dict[str, tuple[DataFrame, DataFrame]], k: int, transition: bool) -> DataFrame:
    """Candidates by vector, then, if configured, temporal neighbours and lexical support, ranked by the final score.

    Scoring is over at most pool rows, whatever the corpus; support holds best scores per frame and per video."""
    hits = search.knn_exact(frames, query, config.pool or k).drop("rank")
    if config.neighbour:
        hits = temporal.neighbor_max(hits)
    for name in config.lexical:
        frame, video = support[name]
        hits = hits.join(frame, "global_id", "left").join(video, "video_id", "left")
    out = fusion.tnca_score(hits, transition, list(config.lexical), config.neighbour)
    order = [F.round("final", 9).desc(), F.col("global_id")]
    return out.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
