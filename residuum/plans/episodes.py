"""Two-state episodes as relations: which chains correspond, one naming for both states, claims, excerpts and renders.

``episodes`` holds ``structure_id`` (the episode), ``chain_map`` (map of state-1 to state-2 chains, may be NULL) and
``exclusions`` (array of chain, first, last of state 1, may be NULL). Both states are atoms under the episode's
``structure_id`` with their own chains. Nothing here goes episode by episode: chain maps are rows, their fits
are aggregates, and the stop rules are filters.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chemistry as chem
from ..functions import hashing as h
from ..functions.texts import token_estimate
from ..operators import cleaning, display, superpose
from ..operators.keyed import argmin_by
from ..session import stage
from ..sources import records, structures
from . import dataset, mechanistic

#: Fixed values.
MAX_MAPS, GOOD_RMSD, MAX_RMSD = 12, 2.0, 5.0
CROP_RADII = (16.0, 13.0, 10.0, 8.0, 6.5)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
EPISODE, OPTIONS_FIELD = "MECH", "mechanism"


def _residues(atoms: DataFrame) -> DataFrame:
    return atoms.selectExpr("structure_id", "residue_idx", "chain", "seq_id", "entity", "name", "poly_index", "label", f"{chem.one_letter('name')} AS one_letter").distinct()


def _chains(residues: DataFrame, out: str, where: str = "true") -> DataFrame:
    """Chains of each structure in file order, one array."""
    first = residues.filter(where).groupBy("structure_id", "chain").agg(F.min("residue_idx").alias("at"))
    return first.groupBy("structure_id").agg(F.expr(f"transform(array_sort(collect_list(struct(at, chain))), c -> c.chain) AS {out}"))


def permutations(chains: str) -> str:
    """The first thirteen orders of an array, in the order of positions; they differ in the last four places only."""
    def tail(m: int) -> str:
        rows = list(itertools.permutations(range(m)))[:MAX_MAPS + 1]
        return "array(" + ", ".join("array(" + ", ".join(map(str, r)) + ")" for r in rows) + ")"
    cases = " ".join(f"WHEN {m} THEN {tail(m)}" for m in (1, 2, 3))
    fixed = f"slice({chains}, 1, greatest(0, size({chains}) - 4))"
    return (f"transform(CASE size({chains}) {cases} ELSE {tail(4)} END, p -> concat({fixed}, transform(p, i -> "
            f"element_at({chains}, CAST(i + greatest(0, size({chains}) - 4) + 1 AS INT)))))")


def chain_maps(episodes: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """``structure_id, map_no, chain_map``: the given map, then every order of the protein chains if there are as many; twelve at most."""
    one, two = _chains(first, "c1", "entity = 'protein'"), _chains(second, "c2", "entity = 'protein'")
    both = episodes.select("structure_id", "chain_map").join(one, "structure_id", "left").join(two, "structure_id", "left")
    orders = f"IF(size(c1) = size(c2), transform({permutations('c2')}, p -> map_from_arrays(c1, p)), array())"
    # Maps are compared as sorted entries; maps themselves have no equality.
    listed = both.selectExpr("structure_id", f"concat(IF(chain_map IS NULL, array(), array(chain_map)), filter({orders}, m -> "
                             "chain_map IS NULL OR NOT (array_sort(map_entries(m)) <=> array_sort(map_entries(chain_map))))) AS maps")
    return listed.selectExpr("structure_id", "posexplode(slice(maps, 1, %d)) AS (map_no, chain_map)" % MAX_MAPS)


def align(episodes: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """The chain map and fit of every episode, or the reason why there is none.

    Maps are tried in order: one whose chains are all alike enough and that leaves three core pairs is fitted; the first with an RMSD of at
    most 2 ends the search, the smallest RMSD so far wins, and above 5 the episode is rejected. Sequences are aligned once
    per pair of chains, not once per map.
    """
    r1, r2 = stage(_residues(first)), stage(_residues(second))
    maps = stage(chain_maps(episodes, r1, r2))
    links = stage(maps.selectExpr("structure_id", "map_no", "explode(chain_map) AS (chain_1, chain_2)"))
    pairs = links.select("structure_id", "chain_1", "chain_2").distinct().selectExpr(
        "structure_id AS pair_id", "structure_id AS structure_1", "chain_1", "structure_id AS structure_2", "chain_2")
    mapped = stage(superpose.map_residues(r1, r2, pairs).filter("accepted").selectExpr(
        "pair_id AS structure_id", "chain_1", "chain_2", "identity", "residue_1", "residue_2", "label_1"))
    known = mapped.select("structure_id", "chain_1", "chain_2").distinct().withColumn("alike", F.lit(True))
    usable = links.join(known, ["structure_id", "chain_1", "chain_2"], "left").groupBy("structure_id", "map_no").agg(F.expr("bool_and(coalesce(alike, false)) AS ok")).filter("ok").drop("ok")
    carbon = [a.filter("atom_name = 'CA'").selectExpr("structure_id", f"residue_idx AS residue_{s}", *[f"{c} AS {p}_{c}" for c in "xyz"]) for a, s, p in ((first, 1, "t"), (second, 2, "m"))]
    rows = links.join(usable, ["structure_id", "map_no"], "left_semi").join(mapped, ["structure_id", "chain_1", "chain_2"]).join(
        carbon[0], ["structure_id", "residue_1"]).join(carbon[1], ["structure_id", "residue_2"])
    out_of_core = episodes.selectExpr("structure_id", "explode(exclusions) AS e").selectExpr("structure_id", "e.chain AS chain_1", "e.first AS low", "e.last AS high")
    left_out = r1.selectExpr("structure_id", "chain AS chain_1", "seq_id", "residue_idx AS residue_1").join(out_of_core, ["structure_id", "chain_1"]).filter(
        "seq_id BETWEEN low AND high").select("structure_id", "residue_1").distinct().withColumn("out", F.lit(True))
    fitted = rows.join(left_out, ["structure_id", "residue_1"], "left").selectExpr(
        "structure_id", "map_no", "residue_1 AS pair_idx", "out IS NULL AS is_core", *[f"{p}_{c}" for p in "mt" for c in "xyz"])
    fits, _ = superpose.superpose_states(fitted, ["structure_id", "map_no"])
    fits = stage(fits)
    stop = fits.filter(f"rmsd_after <= {GOOD_RMSD}D").groupBy("structure_id").agg(F.min("map_no").alias("stop"))
    tried = fits.join(stop, "structure_id", "left").filter("stop IS NULL OR map_no <= stop")
    best = argmin_by(tried, ["structure_id"], ["rmsd_after", "map_no"], ["n_core", "n_outliers", "rotation", "translation"])
    out = episodes.select("structure_id").join(best, "structure_id", "left").join(maps, ["structure_id", "map_no"], "left")
    reason = f"CASE WHEN map_no IS NULL THEN 'no_valid_chain_mapping' WHEN rmsd_after > {MAX_RMSD}D THEN 'alignment_rmsd_too_high' END"
    return out.selectExpr("structure_id", "map_no", "chain_map", "n_core", "n_outliers", "rmsd_after", "rotation", "translation", f"{reason} AS reason")


def renames(aligned: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """``structure_id, chain, new_chain`` of state 2: mapped chains get their state-1 name, others keep theirs if free, else the first free letter.

    Chains are few per structure; each one depends on those before, which is a fold over the array.
    """
    chains = _chains(_residues(first), "c1").join(_chains(_residues(second), "c2"), "structure_id").join(aligned.select("structure_id", "chain_map"), "structure_id")
    inverse = chains.selectExpr("*", "map_from_entries(transform(map_entries(chain_map), e -> struct(e.value, e.key))) AS back")
    letters = chem.sql_literal(list(ALPHABET))
    free = f"element_at(filter({letters}, a -> NOT array_contains(c1, a) AND NOT array_contains(acc.taken, a)), 1)"
    step = f"IF(array_contains(c1, c) OR array_contains(acc.taken, c), {free}, c)"
    start = "named_struct('taken', filter(transform(c2, c -> try_element_at(back, c)), t -> t IS NOT NULL), 'made', CAST(array() AS array<struct<chain: string, new_chain: string>>))"
    fold = (f"aggregate(filter(c2, c -> try_element_at(back, c) IS NULL), {start}, (acc, c) -> named_struct('taken', concat(acc.taken, array({step})), "
            f"'made', concat(acc.made, array(named_struct('chain', c, 'new_chain', {step})))))")
    mapped = "transform(filter(c2, c -> try_element_at(back, c) IS NOT NULL), c -> named_struct('chain', c, 'new_chain', back[c]))"
    return inverse.selectExpr("structure_id", f"explode(concat({mapped}, {fold}.made)) AS r").selectExpr("structure_id", "r.chain AS chain", "r.new_chain AS new_chain")


def harmonised(second: DataFrame, aligned: DataFrame, names: DataFrame) -> DataFrame:
    """State 2 in the frame and under the chain names of state 1; labels and polymer positions are made anew. A name that would occur twice is an error."""
    moved = superpose.apply_superposition(second, aligned.filter("reason IS NULL"), ["structure_id"])
    clash = names.groupBy("structure_id", "new_chain").count().filter("IF(count > 1, raise_error(concat('two chains become ', new_chain, ' in ', structure_id)), false)")
    renamed = moved.join(names.join(clash, ["structure_id", "new_chain"], "left_anti"), ["structure_id", "chain"]).withColumn("chain", F.col("new_chain"))
    labelled = renamed.withColumn("label", F.expr(chem.residue_label("chain", "name", "seq_id", "entity"))).drop("new_chain", "poly_index")
    return cleaning.assign_poly_index(labelled).select(*second.columns)


def resolve_claims(claims: DataFrame, first: DataFrame, second: DataFrame, names: DataFrame) -> DataFrame:
    """Claimed residues in both states, by deposited chain and number, with their final label or the reason why there is none.

    ``claims`` holds ``structure_id, claim, entry_no, state`` (1 or 2), ``chain, seq_id, letter`` (NULL: any).
    """
    parts = []
    for s, atoms in ((1, first), (2, second)):
        # A blank insertion code is preferred, then the first residue in the file.
        residues = _residues(atoms).withColumn("icode", F.lit("")) if "icode" not in atoms.columns else _residues(atoms).join(
            atoms.select("structure_id", "residue_idx", "icode").distinct(), ["structure_id", "residue_idx"])
        hits = argmin_by(residues.selectExpr("*", "IF(trim(icode) = '', 0, 1) AS coded"), ["structure_id", "chain", "seq_id"], ["coded", "residue_idx"], ["label", "one_letter", "name", "entity"])
        own = claims.filter(F.col("state") == s).join(hits, ["structure_id", "chain", "seq_id"], "left")
        if s == 2:
            renamed = own.join(names, ["structure_id", "chain"], "left")
            final = chem.residue_label("coalesce(new_chain, chain)", "name", "seq_id", "entity")
            own = renamed.withColumn("final", F.expr(f"IF(label IS NULL, NULL, {final})"))
        else:
            own = own.withColumn("final", F.col("label"))
        parts.append(own.selectExpr("structure_id", "claim", "entry_no", "state", "chain", "seq_id", "letter", "label AS deposited",
                                    "IF(label IS NULL OR NOT coalesce(one_letter = letter, true), NULL, final) AS label",
                                    "IF(label IS NULL OR NOT coalesce(one_letter = letter, true), 'claim_residue_not_found', NULL) AS reason"))
    return parts[0].unionByName(parts[1])


def crop_centres(resolved: DataFrame, atoms: DataFrame) -> DataFrame:
    """Residues of one state that an excerpt is laid around: all claimed labels it has, and everything that is not polymer."""
    residues = atoms.select("structure_id", "residue_idx", "label", "entity").distinct()
    named = residues.join(resolved.filter("label IS NOT NULL").select("structure_id", "label").distinct(), ["structure_id", "label"], "left_semi")
    return named.unionByName(residues.filter("entity IN ('ligand', 'metal')").select(*named.columns)).select("structure_id", "residue_idx", "label").distinct()


def crop_pairs(first: DataFrame, second: DataFrame, centres_1: DataFrame, centres_2: DataFrame, atom_budget: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both states cut to the union of what a radius keeps in either, by label; the first radius within the budget counts.

    Returns the two states and ``structure_id, radius, n_atoms, reason``.
    """
    first, second = stage(first), stage(second)
    names = [a.select("structure_id", "residue_idx", "label").distinct() for a in (first, second)]
    sized = [a.groupBy("structure_id", "label").agg(F.count(F.lit(1)).alias("n")) for a in (first, second)]
    both = centres_1.select("structure_id").distinct().join(centres_2.select("structure_id").distinct(), "structure_id")
    open_, done, kept = stage(both), [], []
    for radius in CROP_RADII:
        if open_.isEmpty():
            break
        labels = display.union_of_crops(*[display.crop_around(a.join(open_, "structure_id", "left_semi"), c.join(open_, "structure_id", "left_semi"), radius).join(
            n, ["structure_id", "residue_idx"]).select("structure_id", "label") for a, c, n in ((first, centres_1, names[0]), (second, centres_2, names[1]))])
        labels = stage(labels)
        counts = labels.join(sized[0].unionByName(sized[1]), ["structure_id", "label"]).groupBy("structure_id").agg(F.sum("n").alias("n_atoms"))
        counts = stage(counts.selectExpr("structure_id", f"{radius}D AS radius", "n_atoms"))
        fits = counts if atom_budget is None else counts.filter(f"n_atoms <= {atom_budget}")
        done.append(fits)
        kept.append(labels.join(fits, "structure_id", "left_semi"))
        last, open_ = counts, stage(open_.join(fits, "structure_id", "left_anti"))
    none = both.select("structure_id").limit(0)
    sizes, labels = none.selectExpr("structure_id", "0D AS radius", "0L AS n_atoms"), none.selectExpr("structure_id", "'' AS label")
    for d, k in zip(done, kept):
        sizes, labels = sizes.unionByName(d), labels.unionByName(k)
    sizes, labels = stage(sizes), stage(labels)
    everyone = first.select("structure_id").distinct()
    report = everyone.join(sizes, "structure_id", "left").join(both.withColumn("centred", F.lit(True)), "structure_id", "left").selectExpr(
        "structure_id", "radius", "n_atoms", "CASE WHEN centred IS NULL THEN 'no_crop_centers' WHEN radius IS NULL THEN 'over_token_budget_after_crop' END AS reason")
    cut = [display.subset(a, display.crop_like(n, labels)).select(*a.columns) for a, n in ((first, names[0]), (second, names[1]))]
    return cut[0], cut[1], report


def episode_ids(episodes: DataFrame, claims: DataFrame) -> DataFrame:
    """``structure_id, semantic_instance_id``: family, episode and six digits of a hash over the sorted claims."""
    entry = "concat_ws(' ', claim, entry_no, state, chain, seq_id, letter)"
    listed = claims.groupBy("structure_id").agg(F.expr(f"array_sort(collect_list({entry})) AS entries"))
    joined = episodes.select("structure_id").join(listed, "structure_id", "left")
    digest = f"sha2(concat('[', {h.json_string('structure_id')}, ',', coalesce({h.json_string_list('entries')}, '[]'), ']'), 256)"
    return joined.selectExpr("structure_id", f"concat('{EPISODE}-', structure_id, '-', substr({digest}, 1, 6)) AS semantic_instance_id")


#: The five renders of an episode: form, seed number, turned, states in reverse order.
VIEWS = (("minimal_pdb", 0, False, False), ("normalized_coordinates", 0, False, False), ("context_only", 0, False, False), ("minimal_pdb", 1, True, False), ("minimal_pdb", 0, False, True))


def renders(ids: DataFrame, first: DataFrame, second: DataFrame, fields: DataFrame, seed: int) -> DataFrame:
    """Five renders of every episode: three forms, one other turn, one with the states exchanged.

    ``ids`` holds ``structure_id, semantic_instance_id, context, cropped`` and ``options`` (array of code, text); ``fields`` holds
    ``structure_id, field_no, field, answer_schema, prompt`` and the answer columns. Both states move together; in reverse order the
    words of the context are exchanged and so are the answers that depend on the order (in ``gold_fields``, JSON by field).
    """
    text = f"{h.json_string('field')}, ':', {records.gold_json()}"
    asked = fields.groupBy("structure_id").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(field_no, prompt))), f -> f.prompt), '\\n') AS question"),
        F.expr("array_join(transform(array_sort(collect_list(struct(field_no, field, answer_schema))), f -> concat(f.field, ': <', f.answer_schema, '>')), '\\n') AS layout"),
        F.expr(f"concat('{{', array_join(array_sort(collect_list(concat({text}))), ','), '}}') AS gold_fields"))
    swapped = fields.withColumn("gold_text", F.expr(f"IF(field = 'packing_change', {mechanistic.reversed_gold('gold_text')}, gold_text)")).groupBy("structure_id").agg(
        F.expr(f"concat('{{', array_join(array_sort(collect_list(concat({text}))), ','), '}}') AS gold_reversed"))
    rows = stage(ids.join(asked, "structure_id").join(swapped, "structure_id"))
    parts = []
    for number in (0, 1):
        turned = h.derive_seed(h.raw(f"{seed}"), "semantic_instance_id", h.text("rotation"), h.raw(f"{number}"))
        seeds = stage(rows.selectExpr("structure_id", "structure_id AS display_id", f"{turned} AS seed"))
        states = [a.withColumn("display_id", F.col("structure_id")) for a in (first, second)]
        moves = stage(display.transforms(states[0].drop("display_id").unionByName(states[1].drop("display_id")), seeds))
        shown = [stage(_numbered(display.displayed(a, moves).drop("display_id"))) for a in states]
        for form, own, rotated, swapped_order in VIEWS:
            if own == number:
                parts.append(_view(rows.join(seeds.select("structure_id", "seed"), "structure_id"), shown[::-1] if swapped_order else shown, form, rotated, swapped_order))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _numbered(atoms: DataFrame) -> DataFrame:
    from .assembly import renumbered
    return renumbered(atoms)


def _view(rows: DataFrame, shown: list[DataFrame], form: str, turned: bool, swapped: bool) -> DataFrame:
    bare, joined = form == "context_only", rows
    sizes = shown[0].select("structure_id").unionByName(shown[1].select("structure_id")).groupBy("structure_id").agg(F.count(F.lit(1)).alias("atom_count"))
    for n, atoms in enumerate(shown, 1):
        if not bare:
            lines = structures.normalized_table(atoms) if form == "normalized_coordinates" else structures.minimal_pdb(atoms)
            legend = structures.entity_legend(atoms).groupBy("structure_id").agg(
                F.expr("array_join(transform(array_sort(collect_list(struct(residue_idx, line))), l -> l.line), '\\n') AS legend"))
            block = f"concat('Structure {n}:\\n', trim(TRAILING '\\n' FROM text), coalesce(concat('\\n\\nNon-polymer entities in structure {n}:\\n', legend), ''))"
            piece = structures.as_documents(lines).join(legend, "structure_id", "left").selectExpr("structure_id", f"text AS text_{n}", f"{block} AS block_{n}")
            joined = joined.join(piece, "structure_id", "left")
    joined = joined.join(sizes, "structure_id")
    context = mechanistic.reversed_order("context") if swapped else "context"
    notice = f"concat_ws('\\n', '{dataset.NOTICE[form]}', {'NULL' if bare else f'IF(cropped, {chem.sql_literal(dataset.CROP_NOTICE)}, NULL)'}, {'NULL' if bare else chem.sql_literal(dataset.FRAME_NOTICE)})"
    options = "concat('Mechanism options:\\n', array_join(transform(array_sort(options), o -> concat(o.code, '. ', o.text)), '\\n'))"
    body = (f"concat_ws('\\n\\n', {context}, {notice}, " + ("" if bare else "block_1, block_2, ") + f"concat('Question: ', question), {options}, "
            "concat('Report every field, using this exact layout:\\nFINAL\\n', layout))")
    full = joined.selectExpr("*", f"concat({body}, '\\n') AS user_prompt")
    system = chem.sql_literal(dataset.SYSTEM_PROMPT)
    values = {"render_id": f"concat(semantic_instance_id, '::{form}::', seed % 100000000{', ' + repr('::reversed') if swapped else ''})", "question_family": f"'{EPISODE}'", "representation": f"'{form}'",
              "prompt_version": f"'{dataset.PROMPT_VERSION}'", "system_prompt": system, "prompt_sha256": "sha2(user_prompt, 256)",
              "displayed_coordinates_sha256": "sha2('', 256)" if bare else "sha2(concat(text_1, text_2), 256)", "rotation_seed": "seed", "is_rotation_variant": str(turned).lower(),
              "answer_schema": "'multi_field'", "input_token_count": token_estimate(f"concat({system}, char(10), user_prompt)")}
    return full.selectExpr(*[f"{values.get(f.name, f.name)} AS {f.name}" for f in records.RENDER.fields], f"{1 if swapped else 0} AS state_order",
                           f"{'gold_reversed' if swapped else 'gold_fields'} AS gold_fields")
