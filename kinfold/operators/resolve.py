"""From sources to golden records, as lazy tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators import master, matching, search, statistics, survivorship
from kinfold.operators.records import Source, canonical_records
from kinfold.plans.staging import staged


@dataclass
class Resolution:
    """The tables of one run; each is made when first asked for."""

    records: DataFrame
    sources: DataFrame
    priority_source: str = survivorship.DEFAULT_PRIORITY_SOURCE
    require_valid: bool = False
    #: Clusters of the records that are known already.
    known_labels: DataFrame | None = None
    #: The resolution that this one extends, and the records that it adds.
    grown_from: tuple[Resolution, DataFrame] | None = None

    @cached_property
    def keys(self) -> DataFrame:
        if self.grown_from:
            return self.grown_from[0].keys.unionByName(self._more_keys)
        return staged(matching.match_keys(self.records, require_valid=self.require_valid), "keys")

    @cached_property
    def _more_keys(self) -> DataFrame:
        return staged(matching.match_keys(self.grown_from[1], require_valid=self.require_valid), "keys")

    @cached_property
    def identifier_index(self) -> DataFrame:
        return matching.identifier_index(self.keys)

    @cached_property
    def edges(self) -> DataFrame:
        return staged(matching.match_edges(self.keys), "edges")

    @cached_property
    def labels(self) -> DataFrame:
        if self.known_labels is not None:
            return self.known_labels
        if self.grown_from:
            earlier, more = self.grown_from
            return staged(matching.grown_clusters(earlier.labels, earlier.keys, more, self._more_keys), "labels")
        return staged(matching.cluster_records(self.records, self.keys), "labels")

    @cached_property
    def members(self) -> DataFrame:
        return staged(matching.entity_members(self.records, self.labels), "members")

    @cached_property
    def entries(self) -> DataFrame:
        return staged(survivorship.attribute_entries(self.records, self.members), "entries")

    @cached_property
    def survivors(self) -> DataFrame:
        return staged(survivorship.survivors(self.entries, self.priority_source), "survivors")

    @cached_property
    def provenance(self) -> DataFrame:
        return survivorship.field_provenance(self.survivors)

    @cached_property
    def master(self) -> DataFrame:
        return survivorship.master_entities(self.members, self.entries, self.survivors)

    @cached_property
    def statistics(self) -> DataFrame:
        return statistics.system_statistics(self.members, matching.edge_count(self.keys), self.master)

    def trace(self, field: str, value: str) -> DataFrame:
        """How the records of the entity found by ``field`` were linked; only its own edges are made."""
        root = search.entity_of(self.records, self.labels, field, value)
        edges = matching.match_edges(matching.entity_keys(self.keys, self.labels, -1 if root is None else root))
        return search.trace(self.records, self.labels, edges, field, value)

    def wide(self, where: Column | str | None = None) -> DataFrame:
        return master.wide_master(self.members, self.survivors, self.sources, where)


def resolve(sources: list[Source], priority_source: str = survivorship.DEFAULT_PRIORITY_SOURCE, require_valid: bool = False) -> Resolution:
    """Resolve datasets into entities. Raises if two columns of a source stand for one target."""
    for s in sources:
        if len(set(s.targets.values())) < len(s.targets):
            raise ValueError(f"several columns of '{s.source_id}' stand for one target")
    spark = sources[0].df.sparkSession
    names = {s.source_id: s.source_name or s.source_id for s in sources}
    catalogue = spark.createDataFrame(list(names.items()), "source_id string, source_name string")
    return Resolution(staged(canonical_records(sources), "records"), catalogue, priority_source, require_valid)


def extend(earlier: Resolution, sources: list[Source]) -> Resolution:
    """The earlier records and those of more sources, resolved together: stored records are matched as new ones are.

    The earlier clusters are grown by the new records, not found again.
    """
    last = earlier.records.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    more = staged(canonical_records(sources, start=last), "records")
    spark = more.sparkSession
    names = spark.createDataFrame([(s.source_id, s.source_name or s.source_id) for s in sources], "source_id string, source_name string")
    known = earlier.sources.join(names, "source_id", "left_anti").unionByName(names.distinct())
    return Resolution(earlier.records.unionByName(more), known, earlier.priority_source, earlier.require_valid, grown_from=(earlier, more))
