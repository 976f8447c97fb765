"""Entity resolution: mentions in order of arrival become entities, as a sequential upsert would make them.

A mention hits the entity with its canonical key; else the only entity of exactly its type that owns its alias, unless
both have identifiers that differ (an entity without one is promoted to the mention's); else it makes a new entity. An
entity's name is its first mention's, an alias's spelling the last one. Entities never merge afterwards, so the result
depends on order, but only within a component of the graph that links (type, alias) to (type, identifier).

Components without identifiers, or with one alias, one type and one identifier, are solved by an aggregate: there the
rule makes one entity of each key or component. Those are nearly all, and all that are hot by one name. The mentions of
the others go, sorted by component and arrival, through mapInPandas that streams: it holds one component's entities
and aliases, not its mentions. Components of old entities, where every mention finds one and none is added or promoted, are joined too: there
the order does not matter. So mentions are first combined by spelling, by hash and in each task; only those of a component that is walked are looked at one by one. Of a run of equal mentions of a component only the first is walked, since the others hit the same
entity and change nothing; so a component with many mentions of few identities walks as many rows as it has runs.

Ids: a new entity's id is the highest old id plus the sequence number of its first mention.

resolve_into() goes on from a state that is kept between batches and reads of it what a batch touches: an index of nodes, (type, alias) and
(type, identifier), to components, and the entities of these components. A component is called by its least node, so that
components which a batch links merge into the one of least name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.functions.textnorm import casefold
from claimloom.plans.lineage import cut
from claimloom.sources.slots import SLOTS, SlotTable

_COLUMNS = ["kind", "seq", "canonical_key", "canonical_name", "entity_type", "normalized_id", "normalized_alias"]
_SPELLING = _COLUMNS[2:]
IDENTITY = ["canonical_key", "entity_type", "normalized_id", "normalized_alias"]
ENTITY = ["entity_id", "canonical_key", "canonical_name", "entity_type", "normalized_id"]
_OUT = "seq long, entity_id long, canonical_key string, canonical_name string, entity_type string, normalized_id string, component string"


class Resolved(NamedTuple):
    """The entities of mentions: by identity (IDENTITY, entity_id); by seq (seq, entity_id) for mentions of components that are walked, None if none is. Entities made or changed (found), those that stay
    as they were (kept), both with their component, and the spellings used (entity_id, normalized_alias, alias, seq: where last)."""

    groups: DataFrame
    several: DataFrame | None
    found: DataFrame
    kept: DataFrame | None
    spelled: DataFrame

    def of(self, mentions: DataFrame) -> DataFrame:
        """assignments (seq, entity_id) of mentions (seq, identity)."""
        by_identity = joined_on(mentions, self.groups, IDENTITY).select("seq", "entity_id")
        return by_identity if self.several is None else by_identity.unionByName(self.several)


def equal(left: list[Column], right: list[Column]) -> Column:
    """Columns are equal, nulls too. A hash stands first, for a merge sorts by it: keys begin alike."""
    return reduce(and_, [a.eqNullSafe(b) for a, b in zip(left, right)], F.xxhash64(*left) == F.xxhash64(*right))


def joined_on(rows: DataFrame, keyed: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """rows with the other columns of keyed where columns are equal; nulls are equal too."""
    right = keyed.withColumnsRenamed({c: f"_{c}" for c in columns})
    return rows.join(right, equal([F.col(c) for c in columns], [F.col(f"_{c}") for c in columns]), how).drop(*[f"_{c}" for c in columns])


class Arrivals:
    """The entities and aliases of one component so far."""

    def __init__(self) -> None:
        self.entities: dict[int, dict] = {}
        self.by_key: dict[str, int] = {}
        self.owners: dict[tuple[str, str], list[int]] = {}

    def add(self, id_: int, key: str, name: str, kind: str, external: str | None) -> None:
        self.entities[id_] = {"canonical_key": key, "canonical_name": name, "entity_type": kind, "normalized_id": external}
        self.by_key[key] = id_

    def own(self, id_: int, alias: str) -> None:
        owners = self.owners.setdefault((self.entities[id_]["entity_type"], alias), [])
        if id_ not in owners:
            owners.append(id_)

    def resolve(self, new_id: int, key: str, name: str, kind: str, external: str | None, alias: str) -> int:
        id_ = self.by_key.get(key)
        if id_ is None:
            owners = self.owners.get((kind, alias), [])
            if len(owners) == 1:
                known = self.entities[owners[0]]["normalized_id"]
                if external is None or known is None or known.casefold() == external.casefold():
                    id_ = owners[0]
        if id_ is None:
            id_ = new_id
            self.add(id_, key, name, kind, external)
        elif external is not None and self.entities[id_]["normalized_id"] is None:
            entity = self.entities[id_]
            if entity["canonical_key"] != key:
                self.by_key.pop(entity["canonical_key"], None)
                entity["canonical_key"] = key
                self.by_key[key] = id_
            entity["normalized_id"] = external
        self.own(id_, alias)
        return id_


def components_of(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of links (a, b): least labels spread along links, and labels of labels."""
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    labels, before = cut(labels), None
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        labels = labels.join(near, "node").select("node", F.least("component", "near").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        labels = cut(labels.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        now = labels.agg(F.sum(F.xxhash64("node", "component").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return labels
        before = now


def with_nodes(rows: DataFrame) -> DataFrame:
    """rows with of_alias and of_id, the nodes of the graph that a mention or an entity's alias links."""
    kind = casefold(F.col("entity_type"))
    return rows.withColumns({"of_alias": F.concat(kind, F.lit("|a|"), F.coalesce("normalized_alias", F.lit(""))), "of_id": F.concat(kind, F.lit("|i|"), casefold(F.col("normalized_id")))})


def spellings_of(mentions: DataFrame) -> DataFrame:
    """The different spellings of mentions, with their nodes and their first (seq) and last mention; written. They are counted by hash, since only numbers are combined."""
    return cut(with_nodes(mentions.groupBy(*_SPELLING).agg(F.min("seq").alias("seq"), F.max("seq").alias("last"))))


def links_of(rows: DataFrame) -> DataFrame:
    return rows.where("of_id is not null").select(F.col("of_alias").alias("a"), F.col("of_id").alias("b")).distinct()


def resolve_entities(mentions: DataFrame, entities: DataFrame | None = None, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(assignments (seq, entity_id), entities) of mentions (seq >= 1, canonical_key, canonical_name, entity_type, normalized_id, normalized_alias).

    entities and aliases, if given, are the state to start from; of these, only touched components are looked at.
    """
    made = resolve_mentions(mentions, entities, aliases)
    return made.of(mentions), made.found


def resolve_mentions(mentions: DataFrame, entities: DataFrame | None = None, aliases: DataFrame | None = None) -> Resolved:
    """As resolve_entities, by spellings; found has all entities, and no component."""
    spelled, old, highest = spellings_of(mentions), None, 0
    if entities is not None:
        highest = entities.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        old = entities.join(aliases.select(F.col("entity_id").alias("id"), "normalized_alias"), "id", "left").select(F.col("id").alias("seq"), *_SPELLING)
        old = cut(with_nodes(old))
    links = links_of(spelled if old is None else spelled.select("of_alias", "of_id").unionByName(old.select("of_alias", "of_id")))
    if links.isEmpty():
        placed = lambda rows: rows.withColumn("component", F.col("of_alias"))
    else:
        linked = components_of(links).select(F.col("node").alias("of_alias"), "component")
        placed = lambda rows: rows.join(linked, "of_alias", "left").withColumn("component", F.coalesce("component", "of_alias"))
    made = walked(placed(spelled), None if old is None else placed(old), mentions, highest)
    found = made.found.drop("component")
    if entities is not None:
        found = found.unionByName(entities.select(*found.columns).join(found.select("id"), "id", "left_anti"))
    return made._replace(found=found)


def settled(mine: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits (component, IDENTITY, entity_id), components where order matters) of identities (component, IDENTITY) in components of old entities (component, seq: the id, spelling).

    A mention whose key an old entity has hits it; another one hits the only owner of its alias. Where each mention of a component does, none of them gives an entity an identifier, and
    no alias that is looked for by name gets a second owner, nothing that a later mention asks for changes."""
    entity = old.select("component", F.col("seq").alias("entity_id"), "canonical_key", F.col("entity_type").alias("of_type"), F.col("normalized_id").alias("of_external")).distinct()
    owned = old.where("normalized_alias is not null").select("component", "entity_type", "normalized_alias", F.col("seq").alias("owner")).distinct()
    by_key = entity.groupBy("component", "canonical_key").agg(F.max("entity_id").alias("keyed"))  # the last that was added
    by_alias = owned.groupBy("component", "entity_type", "normalized_alias").agg(F.max("owner").alias("owner"), F.count("*").alias("owners"))
    hit = joined_on(joined_on(mine, by_key, ["component", "canonical_key"], "left"), by_alias, ["component", "entity_type", "normalized_alias"], "left")
    hit = hit.withColumn("named", F.col("keyed").isNull()).withColumn("entity_id", F.coalesce("keyed", F.when(F.col("owners") == 1, F.col("owner"))))
    hit = cut(hit.join(entity.drop("canonical_key"), ["component", "entity_id"], "left"))
    differs = F.col("normalized_id").isNotNull() & (F.col("of_external").isNull() | (F.col("named") & (casefold(F.col("of_external")) != casefold(F.col("normalized_id")))))  # promoted, or another entity
    owners = owned.unionByName(hit.where("entity_id is not null").select("component", F.col("of_type").alias("entity_type"), "normalized_alias", F.col("entity_id").alias("owner"))).distinct()
    crowded = owners.groupBy("component", "entity_type", "normalized_alias").agg(F.count("*").alias("n")).where("n > 1")
    asked = joined_on(hit.where("named"), crowded, ["component", "entity_type", "normalized_alias"])
    matters = hit.where(F.col("entity_id").isNull() | differs).select("component").unionByName(asked.select("component")).distinct()
    return hit.select("component", *IDENTITY, "entity_id"), cut(matters)


def walked(spelled: DataFrame, old: DataFrame | None, mentions: DataFrame, highest: int) -> Resolved:
    """Mentions' entities, from their spellings (component, nodes, spelling, seq, last) and the aliases of old entities (component, nodes, spelling, seq: the id), if there are any."""
    single = lambda c: F.min(c).eqNullSafe(F.max(c))
    linked = F.max("of_id").isNotNull()
    shape = spelled.groupBy("component").agg(linked.alias("linked"), (~linked | (single("of_alias") & single("of_id") & single("entity_type"))).alias("plain"))
    known = None if old is None else old.select("component", F.lit(True).alias("known")).distinct()
    shape = shape.withColumn("known", F.lit(None).cast("boolean")) if old is None else shape.join(known, "component", "left")
    way = F.when(F.col("known"), "known").when(F.col("plain"), "plain").otherwise("walk")
    rows = cut(spelled.join(shape.select("component", "linked", way.alias("way")), "component"))
    fast = rows.where("way = 'plain'").withColumn("group", F.when(F.col("linked"), F.col("component")).otherwise(F.col("canonical_key")))
    made = fast.groupBy("group").agg(
        (F.min("seq") + highest).alias("entity_id"), F.max_by("canonical_key", F.struct(F.col("normalized_id").isNotNull(), -F.col("seq"))).alias("canonical_key"),
        F.min_by("canonical_name", "seq").alias("canonical_name"), F.min_by("entity_type", "seq").alias("entity_type"), F.min_by("normalized_id", F.when(F.col("normalized_id").isNotNull(), F.col("seq"))).alias("normalized_id"),
        F.first("component").alias("component"),
    )
    made = cut(made)
    groups = fast.select("group", *IDENTITY).distinct().join(made.select("group", "entity_id"), "group").select(*IDENTITY, "entity_id")
    found, kept, walk = made.select(*ENTITY, "component"), None, rows.where("way = 'walk'")
    if old is not None:
        mine = rows.where("way = 'known'")
        met = cut(old.join(mine.select("component").distinct(), "component", "left_semi").select("component", "of_alias", "of_id", "seq", *_SPELLING))
        hits, matters = settled(mine.select("component", *IDENTITY).distinct(), met)
        groups = groups.unionByName(hits.join(matters, "component", "left_anti").select(*IDENTITY, "entity_id"))
        kept = met.join(matters, "component", "left_anti").select(F.col("seq").alias("id"), *ENTITY[1:], "component").distinct()
        walk = walk.unionByName(mine.join(matters, "component", "left_semi").select(*walk.columns))
    groups, walk = cut(groups), cut(walk.select("component", *_SPELLING))
    spelled = joined_on(rows.select(*_SPELLING, F.col("last").alias("seq")), groups, IDENTITY).select("entity_id", "normalized_alias", F.col("canonical_name").alias("alias"), "seq")
    if walk.isEmpty():
        return Resolved(groups, None, found.withColumnRenamed("entity_id", "id"), kept, spelled)
    rows = joined_on(mentions.select("seq", *_SPELLING), walk, _SPELLING).withColumn("kind", F.lit(1)).select("component", *_COLUMNS)
    if old is not None:
        rows = rows.unionByName(met.join(matters, "component", "left_semi").withColumn("kind", F.lit(0)).select("component", *_COLUMNS))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, at = Arrivals(), None
        empty = lambda v: None if v is None or v != v else v

        def entity_rows() -> list[tuple]:
            return [(None, i, *e.values(), at) for i, e in state.entities.items()]

        frame = lambda rows: pd.DataFrame(rows, columns=["seq", "entity_id", "canonical_key", "canonical_name", "entity_type", "normalized_id", "component"]).astype({"seq": "Int64", "entity_id": "Int64"})
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                if r.component != at:
                    out += entity_rows()
                    state, at = Arrivals(), r.component
                external = empty(r.normalized_id)
                if r.kind == 0:
                    if r.seq not in state.entities:
                        state.add(r.seq, r.canonical_key, r.canonical_name, r.entity_type, external)
                    if empty(r.normalized_alias) is not None:
                        state.own(r.seq, r.normalized_alias)
                else:
                    out.append((r.seq, state.resolve(highest + r.seq, r.canonical_key, r.canonical_name, r.entity_type, external, r.normalized_alias), None, None, None, None, None))
            if out:
                yield frame(out)
        if state.entities:
            yield frame(entity_rows())

    arrival = Window.partitionBy("component").orderBy("kind", "seq")
    same = F.struct("kind", "canonical_key", "entity_type", "normalized_id", "normalized_alias")
    slow = rows.withColumn("begins", (F.col("kind") == 0) | ~F.lag(same).over(arrival).eqNullSafe(same))
    slow = cut(slow.withColumn("run", F.last(F.when(F.col("begins"), F.col("seq")), ignorenulls=True).over(arrival)).select("component", *_COLUMNS, "begins", "run"))
    done = cut(slow.where("begins").select("component", *_COLUMNS).repartition("component").sortWithinPartitions("component", "kind", "seq").mapInPandas(run, _OUT))
    others = slow.where("kind = 1").select("seq", "run", "normalized_alias", F.col("canonical_name").alias("alias"))
    others = cut(others.join(done.where("seq is not null").select(F.col("seq").alias("run"), "entity_id"), "run").select("entity_id", "normalized_alias", "alias", "seq"))
    found = found.unionByName(done.where("seq is null").select(*ENTITY, "component"))
    return Resolved(groups, others.select("seq", "entity_id"), found.withColumnRenamed("entity_id", "id"), kept, spelled.unionByName(others))


def empty_state(spark: SparkSession, folder: str, slots: int = SLOTS) -> tuple[SlotTable, SlotTable]:
    """(index of nodes, entities by component) under a folder; made where there is none."""
    index = SlotTable(spark, f"{folder}/nodes", "node string, component string", "node", slots)
    return index, SlotTable(spark, f"{folder}/components", "component string, id long, canonical_key string, canonical_name string, entity_type string, normalized_id string, aliases array<struct<normalized_alias: string, alias: string>>", "component", slots)


def resolve_into(state: tuple[SlotTable, SlotTable], version: int, mentions: DataFrame) -> DataFrame:
    """assignments (seq, entity_id) of a batch's mentions, after which version of the state holds their entities.

    Mentions (seq, identity) have numbers above those of all batches before; an entity's id is the number of its first mention. Any number of batches
    give what one gives. The state of the version below is left as it is, so that a batch that is delivered again replaces what it did."""
    return resolve_mentions_into(state, version, mentions).of(mentions)


def resolve_mentions_into(state: tuple[SlotTable, SlotTable], version: int, mentions: DataFrame) -> Resolved:
    """As resolve_into, by spellings."""
    index, components = state
    last = index.latest(version)
    rows = spellings_of(mentions)
    links = links_of(rows)
    nodes = rows.select(F.explode(F.array("of_alias", "of_id")).alias("node")).where("node is not null").distinct()
    known = cut(index.read_keys(last, nodes))  # node, component: what the state has of them
    if links.isEmpty():
        joined = known  # no node is linked to another one than it was
    else:
        joined = components_of(links.unionByName(known.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    named = joined.select(F.col("node").alias("of_alias"), "component")
    new = rows.join(named, "of_alias", "left").withColumn("component", F.coalesce("component", "of_alias"))
    labels = known.select("component").distinct()
    moved = joined.select(F.col("node").alias("component"), F.col("component").alias("into"))
    before = cut(components.read_keys(last, labels).join(moved, "component", "left").withColumn("into", F.coalesce("into", "component")))
    old = before.select(F.explode_outer("aliases").alias("a"), F.col("id").alias("seq"), *_SPELLING[:4], F.col("into").alias("component"))
    old = with_nodes(old.select("seq", *_SPELLING[:4], F.col("a")["normalized_alias"].alias("normalized_alias"), "component"))
    made = walked(new, None if last < 0 else cut(old), mentions, 0)
    found = made.found if made.kept is None else made.found.unionByName(made.kept)
    spelled = made.spelled.withColumnRenamed("entity_id", "id")
    kept = before.select("id", F.explode("aliases").alias("a")).select("id", F.col("a")["normalized_alias"].alias("normalized_alias"), F.col("a")["alias"].alias("alias"), F.lit(0).cast("long").alias("seq"))
    latest = spelled.unionByName(kept).groupBy("id", "normalized_alias").agg(F.max_by("alias", "seq").alias("alias"))
    lists = latest.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("normalized_alias", "alias"))).alias("aliases"))
    after = cut(found.join(lists, "id").select(*components.columns))
    ends = with_nodes(after.select("component", "entity_type", "normalized_id", F.explode("aliases").alias("a")).withColumn("normalized_alias", F.col("a")["normalized_alias"]))
    owned = ends.select("component", F.explode(F.array("of_alias", "of_id")).alias("node")).where("node is not null").distinct().select("node", "component")
    components.replace(version, after, labels.unionByName(after.select("component")))
    index.replace(version, owned, owned.select("node"))
    return made
