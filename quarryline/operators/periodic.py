"""The input of periodic reports, for every subject at once.

A subject is a customer or a group of customers: ``scope`` has its rows (subject_id, customer_id). Rankings are limited
within each task before the shuffle; no subject's rows are gathered. ``models`` is the list of preferred models, the report's own first.

Stories take part if their state is ready. The universe is every event of the window that has a result and that none of the chosen stories
holds, all told by customer, sensor and key, as members of a group may use the same keys. What several parts of a report read (chosen stories, the
universe, chosen events, the period's counts) is kept in the shared folder: each source is read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.semantics import canonical_story, overlaps, tier_rank, within
from quarryline.functions.storage import kept
from quarryline.operators.lineage import preferred
from quarryline.sources.views import tier_of

#: List lengths of a report.
TOP_STORIES, TOP_EVENTS, TOP_LIST, EXEMPLARS = 5, 10, 10, 10
#: What an event is told by.
EVENT_KEY = ["customer_id", "sensor", "event_key"]


def _top(rows: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each subject, with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("subject_id").orderBy(*order))).where(F.col("place") <= k)


def story_leaves(incidents: DataFrame, states: DataFrame, results: DataFrame, models: Sequence[str], start: str, end: str) -> DataFrame:
    """Of each ready story whose canonical version overlaps the window its live result of the preferred model, newest generation first."""
    ready = states.where("status = 'ready'").select("customer_id", "story_id").distinct()
    canonical = canonical_story(incidents.join(ready, ["customer_id", "story_id"], "left_semi")).where(overlaps("window_start", "window_end", start, end))
    best = preferred(results.where("not superseded"), ["story_id"], models, [F.desc("generation")])
    return canonical.select("story_id", "story_version", "customer_id", F.col("sensor").alias("story_sensor"), "window_start", "window_end").join(best, "story_id")


def event_leaves(results: DataFrame, models: Sequence[str], start: str, end: str) -> DataFrame:
    """Of each event of the window its live result of the preferred model, all tiers included."""
    live = results.where(~F.col("superseded") & within("event_time", start, end))
    return preferred(live, EVENT_KEY, models, [F.desc("generation")])


def ordered_universe(leaves: DataFrame) -> DataFrame:
    """All leaves in the order of the report: tier, sum of scores, then customer, sensor and key."""
    return leaves.orderBy(*_event_order())


def _event_order() -> list[Column]:
    return [F.desc(tier_rank()), F.desc(F.col("severity") + F.col("likelihood")), F.asc("customer_id"), F.asc("sensor"), F.asc("event_key")]


def top_stories(leaves: DataFrame, k: int = TOP_STORIES) -> DataFrame:
    """Each subject's first stories by tier, sum of scores and id."""
    return _top(leaves, [F.desc(tier_rank()), F.desc(F.col("severity") + F.col("likelihood")), F.asc("customer_id"), F.asc("story_id")], k)


def covered_events(stories: DataFrame, members: DataFrame) -> DataFrame:
    """(subject_id, customer_id, sensor, event_key) that the chosen stories' own versions hold, once each; a member has its story's customer."""
    chosen = stories.select("subject_id", "customer_id", "story_id", "story_version")
    return members.join(chosen, ["story_id", "story_version"]).select("subject_id", "customer_id", "sensor", F.col("member_key").alias("event_key")).distinct()


def uncovered(leaves: DataFrame, covered: DataFrame) -> DataFrame:
    """The universe: leaves of events that no chosen story of the subject holds. What is cited and the long tail are both parts of it."""
    return leaves.join(covered, ["subject_id", *EVENT_KEY], "left_anti")


def top_report_events(universe: DataFrame, k: int = TOP_EVENTS) -> DataFrame:
    """Each subject's first events above LOW."""
    return _top(universe.where("tier <> 'LOW'"), _event_order(), k)


def exemplars(universe: DataFrame, cited: DataFrame, k: int = EXEMPLARS) -> DataFrame:
    """Techniques of the events that the report doesn't cite: count, highest tier and best-ranked event; each subject's first k by tier, count and name.

    ``total`` and ``dropped`` count a subject's techniques and those beyond k. A technique twice in one event counts twice.
    """
    uncited = universe.join(cited.select("subject_id", *EVENT_KEY), ["subject_id", *EVENT_KEY], "left_anti")
    first = F.min(F.struct((-tier_rank()).alias("rank"), (-F.col("severity") - F.col("likelihood")).alias("score"), *EVENT_KEY, "generation", "model"))
    rows = uncited.withColumn("technique", F.explode("tags")).groupBy("subject_id", "technique").agg(F.count("*").alias("n"), first.alias("f"))
    rows = rows.select("subject_id", "technique", "n", (-F.col("f.rank")).alias("tier_rank"), F.col("f.customer_id").alias("customer_id"), F.col("f.sensor").alias("sensor"), F.col("f.event_key").alias("event_key"), F.col("f.generation").alias("generation"), F.col("f.model").alias("model"))
    # A row for each technique of a subject, of which there are some hundreds.
    rows = rows.withColumn("total", F.count("*").over(Window.partitionBy("subject_id")))
    return _top(rows, [F.desc("tier_rank"), F.desc("n"), F.asc("technique")], k).withColumn("dropped", F.greatest(F.col("total") - k, F.lit(0)))


def exemplar_factor(severity: Column, likelihood: Column, none: str = "insufficient evidence") -> Column:
    """The first severity factor, or the first likelihood factor where there is none or only the words for none."""
    s, t = F.get(severity, F.lit(0)), F.get(likelihood, F.lit(0))
    return F.coalesce(F.when(s != none, s), t, s, F.lit(""))


def period_counts(latest: DataFrame, previous: str, start: str, end: str) -> DataFrame:
    """(subject_id, kind, customer_id, name, current_n, previous_n): events of both windows by category, by host and by sensor of a customer, from one scan.

    A category is counted over all of a subject's customers, so it has no customer.
    """
    now, before = within("event_time", start, end), within("event_time", previous, start)
    none = F.lit(None).cast("long")
    one = lambda kind, customer, name: F.struct(F.lit(kind).alias("kind"), customer.cast("long").alias("customer_id"), F.col(name).cast("string").alias("name"))
    kinds = F.array(one("category", none, "category"), one("host", F.col("customer_id"), "primary_asset"), one("sensor", F.col("customer_id"), "sensor"))
    rows = latest.where(now | before).select("subject_id", F.explode(kinds).alias("k"), now.alias("now"))
    return rows.groupBy("subject_id", "k.kind", "k.customer_id", "k.name").agg(F.count_if("now").alias("current_n"), F.count_if(~F.col("now")).alias("previous_n"))


def drift(counts: DataFrame) -> DataFrame:
    """Per subject and category the counts of both windows and the change as a fraction of the former (one at least)."""
    rows = counts.where("kind = 'category'").select("subject_id", F.col("name").alias("category"), "current_n", "previous_n")
    return rows.withColumn("delta", (F.col("current_n") - F.col("previous_n")) / F.greatest("previous_n", F.lit(1)))


def drift_scores(drifted: DataFrame) -> DataFrame:
    """drift_severity (largest change over all former events, at most 1) and drift_likelihood (1 if any change is above 0.3); both 0 without a former period."""
    total = F.sum("previous_n")
    severity = F.when(total == 0, 0.0).otherwise(F.least(F.lit(1.0), F.max(F.abs(F.col("current_n") - F.col("previous_n"))) / F.greatest(total, F.lit(1))))
    likelihood = F.when((total > 0) & (F.max(F.abs("delta")) > 0.3), 1.0).otherwise(0.0)
    return drifted.groupBy("subject_id").agg(severity.alias("drift_severity"), likelihood.alias("drift_likelihood"))


def totals(counts: DataFrame) -> DataFrame:
    """Events and hosts of each subject's window; hosts are distinct within a customer, then summed."""
    now = F.col("current_n") > 0
    rows = counts.groupBy("subject_id").agg(F.sum(F.when(F.col("kind") == "category", F.col("current_n"))).alias("events_total"), F.count_if((F.col("kind") == "host") & now & F.col("name").isNotNull()).alias("hosts"))
    return rows.where("events_total > 0")


def top_sensors(counts: DataFrame, k: int = TOP_LIST) -> DataFrame:
    """Each subject's busiest (customer, sensor) pairs."""
    rows = counts.where("kind = 'sensor' and current_n > 0").select("subject_id", "customer_id", F.col("name").cast("long").alias("sensor"), F.col("current_n").alias("n"))
    return _top(rows, [F.desc("n"), F.asc("customer_id"), F.asc("sensor")], k)


def listed(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """Each subject's texts in the order of their places (of a bounded list), joined by commas."""
    pairs = F.array_sort(F.collect_list(F.struct("place", text.alias("t"))))
    return rows.groupBy("subject_id").agg(F.array_join(F.transform(pairs, lambda x: x["t"]), ",").alias(name))


def canonical_json(fields: dict[str, Column]) -> Column:
    """The fields as JSON with sorted keys; null fields are left out, in nested structs too (whose own fields must be named in order)."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


def canonical_hash(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def references(customer: Column, subject: Column, qualified: bool, order: Sequence[str], **more: Column) -> Column:
    """A reference (customer_id, generation, model and what names the leaf) behind its sort key (``order``, generation).

    Unless ``qualified`` (a group's report), the customer of the report itself is left out.
    """
    named = {"customer_id": customer if qualified else F.when(customer != subject, customer), "generation": F.col("generation"), "model": F.col("model"), **more}
    ref = F.struct(*(named[k].alias(k) for k in sorted(named)))
    return F.struct(*(more[k].alias(f"k{i}") for i, k in enumerate(order)), F.col("generation").alias("g"), F.col("model").alias("m"), customer.alias("c"), ref.alias("ref"))


def _sorted_refs(found: str) -> Column:
    """A bounded list of references in canonical order, whatever order the leaves came in; null if there are none."""
    return F.when(F.size(found) > 0, F.transform(F.array_sort(found), lambda r: r["ref"]))


def report_parts(scope, incidents, states, members, story_results, results, latest, models, previous, start, end) -> dict[str, DataFrame]:
    """The parts of the reports of all subjects, as DataFrames keyed by subject_id. Every source is read once."""
    stories = kept(story_leaves(incidents, states, story_results, models, start, end).join(scope, "customer_id"), "stories")
    chosen = kept(top_stories(stories), "chosen")
    leaves = event_leaves(results, models, start, end).join(scope, "customer_id")
    universe = kept(uncovered(leaves, covered_events(chosen, members)), "universe")
    events = kept(top_report_events(universe), "events")
    counts = kept(period_counts(latest.join(scope, "customer_id"), previous, start, end), "counts")
    return {
        "stories": chosen, "universe": universe, "events": events, "exemplars": exemplars(universe, events), "drift": drift(counts),
        "totals": totals(counts), "sensors": top_sensors(counts), "story_totals": stories.groupBy("subject_id").agg(F.count("*").alias("stories_total")),
    }


def report_leaf_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """(subject_id, kind, place, customer_id, story_id, sensor, event_key, generation, model) of every leaf that a report rests on: what tokens are numbered and policies compared over."""
    none = F.lit(None).cast("long")
    event = lambda name, kind: parts[name].select("subject_id", F.lit(kind).alias("kind"), "place", "customer_id", none.alias("story_id"), "sensor", "event_key", "generation", "model")
    stories = parts["stories"].select("subject_id", F.lit("story").alias("kind"), "place", "customer_id", "story_id", none.alias("sensor"), none.alias("event_key"), "generation", "model")
    return stories.unionByName(event("events", "event")).unionByName(event("exemplars", "exemplar"))


def periodic_report(scope, incidents, states, members, story_results, results, latest, models, previous, start, end, qualified: bool = False, period: str = "DAILY", zone: str = "UTC", language: str = "EN") -> DataFrame:
    """One row for each subject with events or stories: what is cited, totals, lists, tags, scores, tier and the input's hash.

    Scores and tier come from the results of the report's own model and the drift; tags and vulnerabilities from all that is cited. The
    hash is over the report's variant, its lists and the references of its stories, events and exemplars with their generations, so that a leaf that is
    analysed again changes it though nothing else does. ``qualified`` is for groups: references name their customer always.
    """
    p = report_parts(scope, incidents, states, members, story_results, results, latest, models, previous, start, end)
    none = F.lit(None).cast("string")
    story_ref = references(F.col("customer_id"), F.col("subject_id"), qualified, ["story_id"], story_id=F.col("story_id"))
    event_ref = references(F.col("customer_id"), F.col("subject_id"), qualified, ["sensor", "event_key"], sensor=F.col("sensor"), event_key=F.col("event_key"))
    common = ["subject_id", "place", "tags", "model", "severity", "likelihood", "tier"]
    cited = p["stories"].select(*common, "cve", F.lit("story").alias("kind"), F.col("story_id").cast("string").alias("name"), story_ref.alias("story_ref"), F.lit(None).cast(p["events"].select(event_ref).schema[0].dataType).alias("event_ref")).unionByName(
        p["events"].select(*common, none.alias("cve"), F.lit("event").alias("kind"), F.col("event_key").cast("string").alias("name"), event_ref.alias("event_ref")), allowMissingColumns=True
    )
    own = F.col("model") == models[0]
    # Fifteen rows a subject at most, so their lists are bounded.
    in_order = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("place", "name")))), lambda x: x["name"]), ",")
    named = F.flatten(F.collect_list("tags"))
    told = cited.groupBy("subject_id").agg(
        named.alias("tags"), F.array_join(F.array_sort(F.collect_set("cve")), ",").alias("cve_refs"), in_order("story").alias("stories"), in_order("event").alias("events"),
        F.max(F.when(own, F.col("severity"))).alias("own_severity"), F.max(F.when(own, F.col("likelihood"))).alias("own_likelihood"), F.max(F.when(own, tier_rank())).alias("own_rank"),
        F.collect_list("story_ref").alias("story_refs"), F.collect_list("event_ref").alias("event_refs"),
    )
    counted = F.transform(F.array_distinct("tags"), lambda t: F.struct((-F.size(F.filter("tags", lambda o: o == t))).alias("less"), t.alias("t")))
    techniques = F.array_join(F.transform(F.slice(F.array_sort(counted), 1, TOP_LIST), lambda c: F.concat_ws(":", c["t"], -c["less"])), ",")
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    told = told.select(
        "subject_id", "cve_refs", blank("stories").alias("stories"), blank("events").alias("events"), "own_severity", "own_likelihood", "own_rank", F.array_join(F.array_sort(F.array_distinct("tags")), ",").alias("ttp_tags"),
        F.when(F.size("tags") > 0, techniques).alias("techniques"), _sorted_refs("story_refs").alias("story_refs"), _sorted_refs("event_refs").alias("event_refs"),
    )
    tail = p["exemplars"].withColumn("exemplar_ref", event_ref).groupBy("subject_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", "technique", "n", "event_key").alias("t")))), lambda x: x["t"]), ",").alias("exemplars"), F.collect_list("exemplar_ref").alias("exemplar_refs"),
    ).select("subject_id", "exemplars", _sorted_refs("exemplar_refs").alias("exemplar_refs"))
    counts = p["totals"].join(drift_scores(p["drift"]), "subject_id", "full").join(listed(p["sensors"], F.concat_ws(":", "customer_id", "sensor", "n"), "sensors"), "subject_id", "left").join(p["story_totals"], "subject_id", "full")
    out = scope.select("subject_id").distinct()
    # A row for each subject.
    for part in (kept(counts, "period"), told, tail):
        out = out.join(part, "subject_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    drift_s, drift_l = zero("drift_severity") * 100, zero("drift_likelihood") * 100
    names = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
    rank_of = lambda tier: F.array_position(F.array(*map(F.lit, names)), tier) - 1
    tier = F.get(F.array(*map(F.lit, names)), F.greatest(zero("own_rank"), rank_of(tier_of(drift_s, drift_l))).cast("int"))
    out = out.where("events_total is not null or stories_total is not null").select(
        "subject_id", zero("events_total").alias("events_total"), zero("hosts").alias("hosts"), zero("stories_total").alias("stories_total"), "stories", "events", "exemplars", "techniques", "sensors",
        F.coalesce("ttp_tags", F.lit("")).alias("ttp_tags"), F.coalesce("cve_refs", F.lit("")).alias("cve_refs"), F.greatest(drift_s, zero("own_severity").cast("double")).alias("severity"),
        F.greatest(drift_l, zero("own_likelihood").cast("double")).alias("likelihood"), tier.alias("tier"), "story_refs", "event_refs", "exemplar_refs",
    )
    listed_ = ("stories", "events", "exemplars", "techniques", "sensors", "ttp_tags", "cve_refs", "tier", "events_total", "hosts", "stories_total", "story_refs", "event_refs", "exemplar_refs")
    hashed = {"subject": F.col("subject_id"), "period": F.lit(period), "start": F.lit(start), "end": F.lit(end), "zone": F.lit(zone), "language": F.lit(language), "model": F.lit(models[0]), **{c: F.col(c) for c in listed_}}
    return out.withColumn("input_hash", canonical_hash(hashed)).drop("story_refs", "event_refs", "exemplar_refs")


def pinned_report(refs: DataFrame, leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each report's leaves in the order of its references (report, position, *keys), the customer among the keys; a report with a missing reference gives no rows."""
    found = refs.join(leaves.withColumn("_found", F.lit(True)), list(keys), "left")
    lost = found.where(F.col("_found").isNull()).select("report").distinct()
    return found.join(lost, "report", "left_anti").drop("_found")
