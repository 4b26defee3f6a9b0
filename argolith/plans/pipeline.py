"""From posts to predictions: every stage a transformation keyed by thread_id."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argolith.config import ENGLISH, Profile
from argolith.functions.vectors import as_sparse
from argolith.operators import candidates, graph, predict, reasoning, segment, semantics, strengths
from argolith.providers import Client, Cue, EncoderProvider, Lexical, RelationProvider
from argolith.session import materialise, ship


@dataclass
class Run:
    """Results of the stages up to now; stages run when a later one is asked for."""

    posts: DataFrame
    threads: DataFrame
    profile: Profile = ENGLISH
    provider: RelationProvider = Cue()
    #: A model that cuts turns, names the central proposition and labels relations; without one, rules and the provider do.
    client: Client | None = None
    encoder: EncoderProvider = Lexical()
    #: Applied to what several stages read and to what a provider returns: makes a table of it, or nothing.
    keep: object = staticmethod(materialise)

    def __post_init__(self) -> None:
        ship(self.posts.sparkSession)

    @cached_property
    def turns(self) -> DataFrame:
        return segment.clean(self.posts, self.profile)

    @cached_property
    def edus(self) -> DataFrame:
        return self.keep(segment.edus(self.turns, self.profile, self.client, self.keep))

    @cached_property
    def central(self) -> DataFrame:
        if self.client is not None:
            return self.keep(segment.model_central(self.turns, self.edus, self.threads, self.client, self.keep))
        return segment.central_proposition(self.turns, self.edus, self.threads)

    @cached_property
    def index(self) -> DataFrame:
        return self.keep(self.encoder.encode(segment.index(self.edus, self.central)))

    @cached_property
    def pairs(self) -> DataFrame:
        return self.keep(candidates.candidates(self.index, self.encoder.dense))

    @cached_property
    def pacs(self) -> DataFrame:
        return candidates.select(self.pairs, self.index, self.profile)

    @cached_property
    def labelled(self) -> tuple[DataFrame, DataFrame]:
        """(relations, the audit of disputes) as the model's replies have them, before the review."""
        found, audit = reasoning.label(self.index, self.keep(self.pacs), self.client, self.profile, self.keep)
        return self.keep(found), self.keep(audit)

    @cached_property
    def relations(self) -> DataFrame:
        if self.client is None:
            return self.keep(self.provider.label(self.pacs))
        return self.keep(reasoning.review(self.index, self.labelled[0], self.client, self.profile, self.keep))

    @cached_property
    def canonical(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(nodes, edges, components) before repair."""
        e = self.keep(graph.canonical_edges(self.relations))
        n = self.keep(graph.nodes(self.index, e))
        return n, e, self.keep(graph.components(n, e))

    @cached_property
    def graph(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of both modes."""
        return tuple(map(self.keep, graph.assemble(self.index, *self.canonical, self.profile, self.encoder.dense)))

    @cached_property
    def nodes_with_vectors(self) -> DataFrame:
        vec = as_sparse(F.col("vec")) if self.encoder.dense else F.col("vec")
        return self.graph[0].join(self.index.select("thread_id", "global_idx", vec.alias("vec")), ["thread_id", "global_idx"])

    @cached_property
    def final_edges(self) -> DataFrame:
        """Edges after the root's reversal."""
        return self.keep(strengths.reverse_root(*self.graph))

    @cached_property
    def strengths(self) -> DataFrame:
        return self.keep(strengths.initialise(self.nodes_with_vectors, self.graph[1], self.profile))

    @cached_property
    def settled(self) -> DataFrame:
        """Strengths after propagation, over edges after the root's reversal."""
        edges = semantics.weights(self.final_edges, self.profile)
        return self.keep(semantics.propagate(self.strengths, edges, self.profile))

    @property
    def shifts(self) -> DataFrame:
        return semantics.root_shift(self.settled, self.graph[0])

    def evaluated(self, thresholds: list[float]) -> DataFrame:
        return predict.evaluate(self.shifts, self.threads, thresholds)
