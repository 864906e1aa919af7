"""Dataset assembly: accepted candidates become instances with answers and renders, and failed ones make room for the next.

Candidates of a family stand in one order. A family takes them from the front until its target is reached, a cluster
gives at most ``cap`` of them over all families, and a candidate that is published, too long or without a stable answer uses up
nothing. :func:`build` finds the same choice without going one by one: fill the quotas as if all were good, make what was
chosen and is new, take out what failed, and repeat until nothing failed. Every round is one fold over a written relation.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chemistry as chem
from ..functions import hashing as h
from ..functions.texts import token_estimate
from ..operators import cleaning, display, select
from ..operators.keyed import argmin_by
from ..operators.sequence import BLOCK_ROWS, numbered
from ..session import merged, stage
from ..sources import records, structures
from . import dataset
from . import families as fam

#: Excerpt radius of the families that may be shown as an excerpt, and the factors tried one after the other.
CROP_RADIUS = {"T01": 8.0, "G01": 16.0, "G02": 16.0, "G03": 14.0, "N01": 16.0, "S01": 14.0, "S06": 15.0, "S07": 14.0, "S08": 14.0, "S09": 12.0}
SHRINKS = (1.0, 0.75, 0.55, 0.4)
#: How many of the required residues are centres of an excerpt; all of them if not listed.
CENTRES = {"G02": 1, "S06": 1, "S07": 1, "S09": 1, "N01": 2}
#: Answers that turn with the coordinates.
FRAME_BOUND = ("numeric_triple",)
MIN_CONFIDENCE, CONFIDENCE_RADIUS, SHOWN_LABELS = 80.0, 8.0, 8

#: Family: parameters that name the question, answer column, plan over (analysis, asked).
ANSWERS = {
    "P01": ((), "items", lambda a, q: fam.p01_answer(a)), "P02": (("chain",), "number", lambda a, q: fam.p02_answer(a)),
    "P03": (("residue", "atom"), "numbers", lambda a, q: fam.p03_answer(a)), "G01": (("atom1", "atom2"), "number", fam.g01_answer),
    "G02": (("residue", "atom"), "text", lambda a, q: fam.g02_answer(a)), "G03": (("target",), "text", fam.g03_answer),
    "G04": ((), "text", lambda a, q: fam.g04_answer(a)), "S01": (("residue",), "text", lambda a, q: fam.s01_answer(a)),
    "S02": ((), "text", lambda a, q: fam.s02_answer(a)), "S03": (("residue",), "text", lambda a, q: fam.s03_answer(a)),
    "S04": (("residue",), "text", lambda a, q: fam.s04_answer(a)), "S05": (("chain",), "text", lambda a, q: fam.s05_answer(a)),
    "S06": (("ligand",), "items", lambda a, q: fam.s06_answer(a)), "S07": (("metal",), "items", lambda a, q: fam.s07_answer(a)),
    "S08": (("residue",), "text", lambda a, q: fam.s08_answer(a)), "S09": (("residue",), "text", lambda a, q: fam.s09_answer(a)),
    "I01": (("chain_a", "chain_b"), "items", lambda a, q: fam.i01_answer(a)), "N01": (("anchor_a", "anchor_b"), "text", fam.n01_answer),
}
KEY, REASON = "semantic_instance_id", "semantic_instance_id string, reason string, detail string"


@dataclass(frozen=True)
class Plan:
    families: tuple[str, ...]
    targets: dict[str, int]
    seed: int
    token_budget: int
    cap: int = select.PER_SOURCE
    table_share: float = 0.35
    rotation_share: float = 0.25
    version: str = "1"
    #: Structures whose sources are predicted models.
    predicted: str = field(default="false")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _seed(plan: Plan, *parts) -> str:
    return h.derive_seed(h.raw(f"{plan.seed}"), *parts)


# -- which candidates there are -----------------------------------------------------

def admissible(proposals: DataFrame, atoms: DataFrame, plan: Plan, confidence: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Proposals that may be asked, and ``structure_id, family, reason, detail`` of the others.

    Predicted models are not asked for families that need an experiment, nor near residues of low confidence.
    ``confidence`` holds ``structure_id, label, confidence``; a missing value counts as 100.
    """
    marked = stage(proposals.selectExpr("*", f"{plan.predicted} AS _predicted", f"{dataset.instance_id()} AS {KEY}"))
    barred = f"_predicted AND {chem.in_list('family', fam.NOT_FOR_PREDICTED)}"
    refused = marked.filter(barred).select("structure_id", "family").distinct().selectExpr("*", "'afdb_ineligible_for_family' AS reason", "family AS detail")
    open_ = marked.filter(f"NOT ({barred})")
    failed = open_.filter("NOT accepted").selectExpr("structure_id", "family", "reason", "parameters AS detail")
    accepted = open_.filter("accepted")
    if confidence is None:
        return accepted.drop("_predicted", KEY), refused.unionByName(failed)
    # Every quoted word of the parameters that is a label counts as asked for; other words find no residue.
    asked = accepted.filter("_predicted").selectExpr(KEY, "structure_id", "family", "explode(array_union(required, regexp_extract_all(parameters, '\"([^\"]+)\"', 1))) AS label")
    residues = atoms.select("structure_id", "residue_idx", "label").distinct().join(merged(confidence), ["structure_id", "label"], "left")
    asked = stage(merged(asked).join(merged(residues.select("structure_id", "label", "residue_idx")), ["structure_id", "label"]))
    low = cleaning.low_confidence(atoms, residues, asked, CONFIDENCE_RADIUS, MIN_CONFIDENCE).selectExpr("structure_id", "queried_idx AS residue_idx", "label AS low")
    near = stage(merged(asked).join(merged(low), ["structure_id", "residue_idx"]).groupBy(KEY, "structure_id", "family").agg(F.expr("array_sort(collect_set(low)) AS low")))
    doubtful = near.selectExpr("structure_id", "family", "'afdb_low_plddt_near_query' AS reason", f"array_join(slice(low, 1, {SHOWN_LABELS}), ',') AS detail")
    return accepted.join(merged(near), KEY, "left_anti").drop("_predicted", KEY), _union([refused, failed, doubtful])


# -- showing and answering ----------------------------------------------------------

def shown(base: DataFrame, seeds: DataFrame) -> DataFrame:
    """Atoms as displayed, one rigid move per ``structure_id``; ``seeds`` holds ``structure_id, seed``."""
    moves = stage(display.transforms(base, seeds.selectExpr("structure_id", "structure_id AS display_id", "seed")))
    return stage(display.displayed(base.withColumn("display_id", F.col("structure_id")), moves).drop("display_id"))


def renumbered(atoms: DataFrame) -> DataFrame:
    """Residues and serials numbered without gaps, as the lines of a text are."""
    residues = numbered(atoms.select("structure_id", "residue_idx").distinct(), ["structure_id"], ["residue_idx"], f"residue_idx div {BLOCK_ROWS}", "_residue")
    joined = atoms.join(residues, ["structure_id", "residue_idx"]).drop("residue_idx").withColumnRenamed("_residue", "residue_idx").drop("serial")
    placed = numbered(joined, ["structure_id"], ["atom_idx"], f"atom_idx div {BLOCK_ROWS}", "_place")
    return placed.selectExpr("* EXCEPT (_place)", "_place + 1 AS serial")


def answers(a: fam.Analysis, asked: DataFrame, family: str) -> DataFrame:
    """``structure_id`` and the answer columns for questions ``structure_id, parameters`` of one family; no row without a unique answer."""
    keys, value, plan = ANSWERS[family]
    named = asked.selectExpr("structure_id", *[f"get_json_object(parameters, '$.{k}') AS {k}" for k in keys],
                             *(["from_json(get_json_object(parameters, '$.candidates'), 'array<string>') AS candidates"] if family == "G03" else []))
    got = plan(a, named)
    found = named.select("structure_id", *keys).join(got.select("structure_id", *keys, value), ["structure_id", *keys])
    kept = {f"gold_{value}": f"CAST({value} AS {dict((f.name, f.dataType.simpleString()) for f in records.GOLD_FIELDS)[f'gold_{value}']})"}
    return found.selectExpr("structure_id", *[f"{kept.get(f.name, f'CAST(NULL AS {f.dataType.simpleString()})')} AS {f.name}" for f in records.GOLD_FIELDS]).filter(f"gold_{value} IS NOT NULL")


def all_answers(displayed: DataFrame, asked: DataFrame, families: list[str]) -> DataFrame:
    """Answers recomputed from what is displayed; every instance is a structure of its own here."""
    parts = []
    for family in families:
        own = asked.filter(F.col("family") == family)
        a = fam.Analysis(displayed.join(own.select("structure_id"), "structure_id", "left_semi"))
        parts.append(answers(a, own, family))
    return stage(_union(parts))


def prompts(displayed: DataFrame, ids: DataFrame, form: str) -> DataFrame:
    """``ids`` with ``text``, ``user_prompt``, ``tokens`` and ``atom_count`` in one form."""
    bare, none = form == "context_only", F.lit(None).cast("string")
    sizes = displayed.groupBy("structure_id").agg(F.expr("count(*) AS atom_count"))
    if bare:
        joined = ids.withColumns({"text": none, "legend": none, "cropped": F.lit(False)})
    else:
        lines = structures.normalized_table(displayed) if form == "normalized_coordinates" else structures.minimal_pdb(displayed)
        legend = structures.entity_legend(displayed).groupBy("structure_id").agg(
            F.expr("array_join(transform(array_sort(collect_list(struct(residue_idx, line))), l -> l.line), '\\n') AS legend"))
        joined = ids.join(structures.as_documents(lines), "structure_id").join(legend, "structure_id", "left")
    joined = joined.join(sizes, "structure_id")
    notice = f"concat_ws('\\n', '{dataset.NOTICE[form]}', IF(cropped, '{dataset.CROP_NOTICE}', NULL), {'NULL' if bare else repr(dataset.FRAME_NOTICE)})"
    body = (f"concat_ws('\\n\\n', {notice}, " + ("" if bare else "concat('Structure:\\n', trim(TRAILING '\\n' FROM text)), concat('Non-polymer entities:\\n', legend), ")
            + f"concat('Question: ', {dataset.question_text()}), '{dataset.FINISH}')")
    return joined.selectExpr("*", f"concat({body}, '\\n') AS user_prompt").selectExpr(
        "*", f"{token_estimate(f'concat({chem.sql_literal(dataset.SYSTEM_PROMPT)}, char(10), user_prompt)')} AS tokens")


def _excerpts(base: DataFrame, ids: DataFrame, shrink: float) -> tuple[DataFrame, DataFrame]:
    """Excerpts of ``ids``, and the reasons why some have none."""
    residues = base.select("structure_id", "residue_idx", "label").distinct()
    count = chem.lookup({k: str(v) for k, v in CENTRES.items()}, "family")
    centres = stage(ids.selectExpr("structure_id", f"explode(slice(required, 1, CAST(coalesce({count}, size(required)) AS INT))) AS label").join(residues, ["structure_id", "label"]))
    # Distances in units of the radius: one join for all radii.
    unit = f"({chem.lookup(CROP_RADIUS, 'family')} * {shrink}D)"
    scaled = base.join(ids.select("structure_id", "family"), "structure_id").selectExpr("structure_id", "residue_idx", "entity", *[f"{c} / {unit} AS {c}" for c in "xyz"])
    kept = stage(display.crop_around(scaled, centres.select("structure_id", "residue_idx"), 1.0))
    wanted = ids.selectExpr("structure_id", "explode(required) AS label").join(residues, ["structure_id", "label"], "left")
    lost = wanted.join(kept, ["structure_id", "residue_idx"], "left_anti").groupBy("structure_id").agg(F.expr("array_join(array_sort(collect_set(label)), ',') AS detail"))
    uncentred = ids.join(centres, "structure_id", "left_anti").selectExpr(f"structure_id AS {KEY}", "'no_crop_centers' AS reason", "family AS detail")
    failed = lost.join(centres, "structure_id", "left_semi").selectExpr(f"structure_id AS {KEY}", "'materialisation_failed' AS reason", "concat('lost from the excerpt: ', detail) AS detail")
    failed = stage(uncentred.unionByName(failed))
    good = base.join(ids, "structure_id", "left_semi").join(failed.selectExpr(f"{KEY} AS structure_id"), "structure_id", "left_anti")
    return stage(renumbered(display.subset(good, kept))), failed


def materialise(chosen: DataFrame, atoms: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers, renders and failures (``semantic_instance_id, reason, detail``) of chosen candidates.

    ``atoms`` carries the columns a text needs. Each instance shows its own copy of a structure, moved by its own seed; that
    is what a dataset is, so atoms multiply by the instances chosen, not by the candidates there are.
    """
    ids = stage(chosen.selectExpr(f"{KEY} AS structure_id", "structure_id AS source", "family", "parameters", "required", f"{_seed(plan, KEY, h.text('rotation'), h.raw('0'))} AS seed", "false AS cropped"))
    base = stage(renumbered(atoms.withColumnRenamed("structure_id", "source").join(ids.select("source", "structure_id"), "source").drop("source")))
    whole = shown(base, ids)
    first = stage(prompts(whole, ids, "minimal_pdb").select("structure_id", "tokens"))
    sized = stage(ids.join(first, "structure_id"))
    over = sized.filter(f"tokens > {plan.token_budget}")
    croppable = chem.in_list("family", tuple(CROP_RADIUS))
    failures = [over.filter(f"NOT {croppable}").selectExpr(f"structure_id AS {KEY}", "'over_token_budget_and_not_croppable' AS reason", "CAST(tokens AS STRING) AS detail")]
    fits, bases, shows = [sized.filter(f"tokens <= {plan.token_budget}").drop("tokens")], [base], [whole]
    todo = stage(over.filter(croppable).drop("tokens").withColumn("cropped", F.lit(True)))
    for shrink in SHRINKS:
        if todo.isEmpty():
            break
        part, failed = _excerpts(base.join(todo, "structure_id", "left_semi"), todo, shrink)
        view = shown(part, todo)
        measured = stage(prompts(view, todo, "minimal_pdb").select(*todo.columns, "tokens"))
        done = measured.filter(f"tokens <= {plan.token_budget}").drop("tokens")
        failures.append(failed)
        fits.append(done)
        bases.append(part.join(done, "structure_id", "left_semi"))
        shows.append(view.join(done, "structure_id", "left_semi"))
        todo = stage(measured.filter(f"tokens > {plan.token_budget}").drop("tokens"))
    failures.append(todo.selectExpr(f"structure_id AS {KEY}", "'over_token_budget_after_crop' AS reason", f"'{SHRINKS[-1]}' AS detail"))
    fit = stage(_union(fits))
    whole_fit = fits[0].select("structure_id")
    # A structure that was cut is read from its excerpt only.
    view = stage(_union([shows[0].join(whole_fit, "structure_id", "left_semi"), *shows[1:]]))
    final = stage(_union([bases[0].join(whole_fit, "structure_id", "left_semi"), *bases[1:]]))
    present = [r.family for r in fit.select("family").distinct().orderBy("family").collect()]
    if not present:
        empty = atoms.sparkSession.createDataFrame([], records.RENDER)
        return empty.selectExpr(KEY).join(_no_answers(atoms.sparkSession), KEY), empty, stage(_union(failures))
    gold = all_answers(view, fit, present)
    failures.append(fit.join(gold, "structure_id", "left_anti").selectExpr(f"structure_id AS {KEY}", "'materialisation_failed' AS reason", "'no unique answer' AS detail"))
    turned, moved = _rotated(final, fit.join(gold, "structure_id", "left_semi"), gold, plan)
    failures.append(moved)
    out = [_records(view, fit, gold, "minimal_pdb", False), _records(view, _tabled(fit, plan), gold, "normalized_coordinates", False)]
    out.append(_records(view, fit.filter(chem.in_list("family", fam.CONTEXT_ONLY)), gold, "context_only", False))
    if turned is not None:
        out.append(_records(*turned, "minimal_pdb", True))
    return gold.withColumnRenamed("structure_id", KEY), stage(_union(out)), stage(_union(failures))


def _no_answers(spark) -> DataFrame:
    return spark.createDataFrame([], f"{KEY} string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in records.GOLD_FIELDS))


def _tabled(ids: DataFrame, plan: Plan) -> DataFrame:
    return ids.filter(select.coin(_seed(plan, h.text("representation_variant"), "structure_id"), plan.table_share))


def _rotated(base: DataFrame, ids: DataFrame, gold: DataFrame, plan: Plan):
    """A second view of some instances, and the instances whose answer it changes."""
    seed = _seed(plan, "structure_id", h.text("rotation"), h.raw("1"))
    turning = stage(ids.filter(select.coin(_seed(plan, h.text("rotation_variant"), "structure_id"), plan.rotation_share)).withColumn("seed", F.expr(seed)))
    families = [r.family for r in turning.select("family").distinct().orderBy("family").collect()]
    if not families:
        return None, base.sparkSession.createDataFrame([], REASON)
    view = shown(base.join(turning, "structure_id", "left_semi"), turning)
    again = all_answers(view, turning, families)
    bound = chem.in_list(chem.lookup(dataset.SCHEMA, "family"), FRAME_BOUND)
    both = turning.select("structure_id", "family").join(gold.selectExpr("structure_id", f"{records.gold_json('false')} AS one"), "structure_id").join(
        again.selectExpr("structure_id", f"{records.gold_json('false')} AS two"), "structure_id", "left")
    moved = both.filter(f"NOT ({bound}) AND NOT (one <=> two)").selectExpr(f"structure_id AS {KEY}", "'gold_answer_changed_under_rotation' AS reason", "concat(one, ' ', coalesce(two, 'null')) AS detail")
    return (view, turning, again), stage(moved)


def _records(view: DataFrame, ids: DataFrame, gold: DataFrame, form: str, turned: bool) -> DataFrame:
    known = ids.join(gold.select("structure_id"), "structure_id", "left_semi")
    rows = prompts(view.join(known, "structure_id", "left_semi"), known, form)
    system = chem.sql_literal(dataset.SYSTEM_PROMPT)
    values = {"render_id": f"concat(structure_id, '::{form}::', seed % 100000000)", KEY: "structure_id", "question_family": "family", "representation": f"'{form}'",
              "prompt_version": f"'{dataset.PROMPT_VERSION}'", "system_prompt": system, "prompt_sha256": "sha2(user_prompt, 256)",
              "displayed_coordinates_sha256": "sha2('', 256)" if form == "context_only" else "sha2(text, 256)", "rotation_seed": "seed", "is_rotation_variant": str(turned).lower(),
              "answer_schema": chem.lookup(dataset.SCHEMA, "family"), "input_token_count": "tokens"}
    return rows.selectExpr(*[f"{values.get(f.name, f.name)} AS {f.name}" for f in records.RENDER.fields])


# -- the build ----------------------------------------------------------------------

def build(candidates: DataFrame, atoms: DataFrame, plan: Plan, published: DataFrame | None = None, decisions: DataFrame | None = None,
          accepted_only: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Instances, renders, and failures of candidates that were reached.

    ``candidates`` are placed rows of :func:`dataset.ordered_candidates`. ``published`` has a text column ``value``, one instance a line.
    ``decisions`` set status, notes and answers; instances that a decision rejects leave after the choice, as their slots are taken by then.
    """
    named = stage(candidates.selectExpr("*", f"{dataset.instance_id()} AS {KEY}"))
    none = named.sparkSession.createDataFrame([], REASON)
    # What is published is known before anything is made.
    failed = none if published is None else stage(named.join(records.listed_ids(published), KEY, "left_semi").selectExpr(
        KEY, "'answer_previously_published' AS reason", f"{KEY} AS detail"))
    known, gold, renders = none.select(KEY), [], []
    while True:
        chosen = stage(select.quota_fold(named.join(failed, KEY, "left_anti"), list(plan.families), plan.targets, plan.cap))
        fresh = stage(chosen.join(known, KEY, "left_anti"))
        if fresh.isEmpty():
            break
        got, shown_as, bad = materialise(fresh, atoms, plan)
        gold.append(got)
        renders.append(shown_as)
        known = stage(known.unionByName(fresh.select(KEY)))
        # One reason a candidate: what failed first on its way.
        failed = stage(_union([failed, argmin_by(bad, [KEY], ["reason", "detail"]).select(KEY, "reason", "detail")]))
    if not gold:  # no candidate at all
        return _instances(chosen, _no_answers(named.sparkSession), plan, decisions), named.sparkSession.createDataFrame([], records.RENDER), none
    instances = _instances(chosen, _union(gold), plan, decisions)
    instances = stage(instances.filter("curation_status = 'accepted'" if accepted_only else "curation_status <> 'rejected'"))
    return instances, _union(renders).join(instances, KEY, "left_semi"), _reached(named, chosen, failed, plan)


def _reached(named: DataFrame, chosen: DataFrame, failed: DataFrame, plan: Plan) -> DataFrame:
    """Failures of candidates that come before a family is full and whose cluster still had room."""
    order = "CASE family " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(plan.families)) + " END"
    target = "CASE family " + " ".join(f"WHEN '{f}' THEN {plan.targets.get(f, 0)}" for f in plan.families) + " END"
    taken = stage(chosen.selectExpr("family", "cluster", "place", f"{order} AS turn_of_family"))
    ends = taken.groupBy("family").agg(F.expr("count(*) AS n"), F.expr("max(place) AS last")).filter(f"n >= {target}").select("family", "last")
    rows = named.drop("reason").join(failed, KEY).selectExpr(KEY, "family", "structure_id", "cluster", "place", f"{order} AS own_turn", "reason", "detail")
    # At most ``cap`` chosen rows meet a failed one.
    before = rows.join(taken.selectExpr("cluster", "place AS p", "turn_of_family"), "cluster").filter(
        "turn_of_family < own_turn OR (turn_of_family = own_turn AND p < place)").groupBy(KEY).agg(F.expr("count(*) AS used"))
    open_ = rows.join(ends, "family", "left").filter("last IS NULL OR place < last").join(before, KEY, "left").filter(f"coalesce(used, 0) < {plan.cap}")
    return open_.select(KEY, "family", "structure_id", "reason", "detail")


def _instances(chosen: DataFrame, gold: DataFrame, plan: Plan, decisions: DataFrame | None) -> DataFrame:
    from . import evaluation
    joined = chosen.join(gold, KEY).selectExpr("*", f"{chem.lookup(dataset.SCHEMA, 'family')} AS answer_schema")
    joined = evaluation.decided(joined, decisions)
    values = {KEY: KEY, "question_family": "family", "question_version": f"'{plan.version}'", "protein_group_id": "structure_id", "cluster": "cluster",
              "source_type": f"IF({plan.predicted}, 'afdb', 'pdb')", "source_entries": "array(structure_id)", "source_file_sha256s": "CAST(array() AS array<string>)",
              "question_parameters": "parameters", "gold_hash": f"sha2({records.gold_json()}, 256)", "selection_margins": "concat('{\"rank\":', rank, '}')",
              "definition_version": f"'{plan.version}'", "required_labels": "required"}
    return joined.selectExpr(*[f"{values.get(f.name, f.name)} AS {f.name}" for f in records.INSTANCE.fields], "curator_notes", "curator_override")
