"""From accepted candidates to instances, renders and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as h
from ..functions.texts import token_estimate
from ..operators import select
from ..operators.keyed import first_per_key
from ..session import beside
from ..sources import structures
from . import families as fam

PROMPT_VERSION = "1"
SYSTEM_PROMPT = "You answer questions about molecular structures from the data you are given. End with one line that starts with FINAL:."
NOTICE = {
    "minimal_pdb": "The structure follows as fixed-column coordinate records.",
    "normalized_coordinates": "The structure follows as comma-separated coordinates.",
    "context_only": "No coordinates are given with this question.",
}
FRAME_NOTICE = "The whole structure was moved as one rigid body; only relative positions carry meaning."
CROP_NOTICE = "The records are a local excerpt of a larger structure."
FINISH = "Finish with a line FINAL: followed by the answer."
#: One sentence per family; named places are filled from the parameters.
QUESTIONS = {
    "P01": "Which chain identifiers occur in the structure?", "P02": "How many protein residues does chain {chain} have?",
    "P03": "What are the x, y and z coordinates of atom {residue}:{atom}?", "G01": "How far apart, in Angstrom, are atoms {atom1} and {atom2}?",
    "G02": "Which protein atom is nearest to {residue}:{atom} without being bonded to it directly or through one atom?",
    "G03": "Which of these residues comes nearest to {target}: {candidates}?", "G04": "Which two residues overlap most severely?",
    "S01": "Which residue forms a salt bridge with {residue}?", "S02": "Which residue is phosphorylated?",
    "S03": "Is {residue} buried or solvent-exposed?", "S04": "Is {residue} in a helix, a strand or a coil?",
    "S05": "Is chain {chain} predominantly alpha helical, predominantly beta sheet, or mixed alpha/beta?",
    "S06": "Which protein residues have an atom within 4.0 Angstrom of {ligand}?", "S07": "Which protein residues coordinate {metal}?",
    "S08": "Which cysteine is {residue} bonded to through sulfur?", "S09": "Is the chi1 rotamer of {residue} g+, t or g-?",
    "I01": "Which residues of chain {chain_a} have an atom within 4.0 Angstrom of chain {chain_b}?",
    "N01": "Which single residue touches both {anchor_a} and {anchor_b}?",
    "T01": "Which of these contacts are gained and which are lost in the second structure: {candidates}?",
}
SCHEMA = {"P01": "string_set", "P02": "integer", "P03": "numeric_triple", "G01": "distance", "G02": "atom", "G03": "residue", "G04": "residue_pair",
          "S01": "residue", "S02": "residue", "S03": "category", "S04": "category", "S05": "category", "S06": "residue_set", "S07": "residue_set",
          "S08": "residue", "S09": "category", "I01": "residue_set", "N01": "residue", "T01": "two_interaction_sets"}


def instance_id() -> str:
    """``family-structure-hash8`` over family, structure and parameters."""
    digest = h.stable_hash("family", "structure_id", "parameters")
    return f"concat(family, '-', structure_id, '-', substr({digest}, 1, 8))"


def ordered_candidates(proposals: DataFrame, families: list[str], targets: dict[str, int], seed: int, cluster: str = "structure_id") -> DataFrame:
    """Accepted candidates through the seeded pool, the spread over tags and the round-robin: ``place`` within the family, at most four times the target."""
    key = ["family", "structure_id"]
    accepted = proposals.filter("accepted")
    draw = h.derive_seed(("raw", f"'{seed}'"), h.text("candidate"), "family", "structure_id", "parameters")
    pool = select.pooled_order(accepted, key, ["rank", "parameters"], draw)
    spread = select.diversified(pool, key, "tag", select.pooled_terms(["rank", "parameters"]))
    order = h.derive_seed(("raw", f"'{seed}'"), h.text("protein"), "cluster")
    most = max(targets.values(), default=0) * select.OVERSAMPLE
    turns = first_per_key(spread.selectExpr("*", f"{cluster} AS cluster"), ["family", "cluster"], ["structure_id", "pick"], most, "turn").selectExpr(
        "*", f"{order} AS cluster_seed")
    placed = None
    for family in families:
        limit = targets.get(family, 0) * select.OVERSAMPLE
        if limit:
            rows = turns.filter(F.col("family") == family).orderBy("turn", "cluster_seed", "cluster").limit(limit).selectExpr(
                "*", "row_number() OVER (PARTITION BY family ORDER BY turn, cluster_seed, cluster) AS place", "true AS usable")
            placed = rows if placed is None else placed.unionByName(rows)
    if placed is None:
        return accepted.selectExpr("*", f"{cluster} AS cluster", "1 AS place", "true AS usable").limit(0)
    return fam.stage(placed)


def select_candidates(proposals: DataFrame, families: list[str], targets: dict[str, int], seed: int, cap: int = 6,
                      cluster: str = "structure_id") -> DataFrame:
    """Candidates in order, and of those what the quotas leave."""
    return select.quota_fold(ordered_candidates(proposals, families, targets, seed, cluster), families, targets, cap)


def question_text() -> str:
    """The question of a row from its family and its JSON parameters."""
    names = sorted({n for q in QUESTIONS.values() for n in _places(q)})
    cases = " ".join(f"WHEN '{f}' THEN '{q}'" for f, q in QUESTIONS.items())
    text = f"CASE family {cases} END"
    for n in names:
        value = f"coalesce(get_json_object(parameters, '$.{n}'), '')"
        plain = f"regexp_replace(translate({value}, '[]', ''), char(34), '')" if n == "candidates" else value
        text = f"replace({text}, '{{{n}}}', {plain})"
    return text


def _places(template: str) -> list[str]:
    return [part.split("}")[0] for part in template.split("{")[1:]]


def renders(instances: DataFrame, atoms: DataFrame, seed: int, table_share: float = 0.35) -> DataFrame:
    """Prompts of every instance: coordinates always, the table form and the bare question where chosen.

    ``atoms`` are displayed atoms by ``structure_id``. Structure texts are built once per structure
    and form, then joined to the instances that need them.
    """
    texts = None
    for form, lines in (("minimal_pdb", structures.minimal_pdb(atoms)), ("normalized_coordinates", structures.normalized_table(atoms))):
        doc = structures.as_documents(lines).withColumn("representation", F.lit(form))
        texts = doc if texts is None else texts.unionByName(doc)
    legend = structures.entity_legend(atoms).groupBy("structure_id").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(residue_idx, line))), l -> l.line), '\\n') AS legend"))
    coin = select.coin(h.derive_seed(("raw", f"'{seed}'"), h.text("representation_variant"), "semantic_instance_id"), table_share)
    blind = ", ".join(f"'{f}'" for f in fam.CONTEXT_ONLY)
    forms = (f"filter(array('minimal_pdb', IF({coin}, 'normalized_coordinates', NULL), IF(family IN ({blind}), 'context_only', NULL)), r -> r IS NOT NULL)")
    wanted = instances.selectExpr("*", f"explode({forms}) AS representation").join(texts, ["structure_id", "representation"], "left").join(
        legend, "structure_id", "left")
    notice = "CASE representation " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NOTICE.items()) + " END"
    body = ("concat_ws('\\n\\n', " + notice + f", IF(representation = 'context_only', NULL, '{FRAME_NOTICE}'), "
            "IF(representation = 'context_only', NULL, concat('Structure:\\n', trim(TRAILING '\\n' FROM text))), "
            "IF(representation = 'context_only' OR legend IS NULL, NULL, concat('Non-polymer entities:\\n', legend)), "
            f"concat('Question: ', {question_text()}), '{FINISH}')")
    return wanted.selectExpr("*", f"concat({body}, '\\n') AS user_prompt").selectExpr(
        "concat(semantic_instance_id, '::', representation) AS render_id", "semantic_instance_id", "family AS question_family", "representation",
        f"'{PROMPT_VERSION}' AS prompt_version", "user_prompt", "sha2(user_prompt, 256) AS prompt_sha256", "sha2(text, 256) AS displayed_coordinates_sha256",
        f"{token_estimate('user_prompt')} AS input_token_count")


def over_budget(rendered: DataFrame, budget: int) -> DataFrame:
    return rendered.filter(f"input_token_count > {budget}").selectExpr(
        "semantic_instance_id", "'over_token_budget' AS reason", "input_token_count AS detail")


def build_summary(instances: DataFrame, rendered: DataFrame, rejections: DataFrame) -> DataFrame:
    tokens = rendered.agg(F.expr("count(*) AS renders"), F.expr("max(input_token_count) AS max_tokens"), F.expr("avg(input_token_count) AS mean_tokens"))
    counted = beside(instances.agg(F.expr("count(*) AS instances")), tokens)
    return beside(counted, rejections.agg(F.expr("count(*) AS rejections")))
