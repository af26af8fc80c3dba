"""Answer and label parsing as native Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.core.expr import let

# word boundaries spelled out for all letters, since the engine's \b differs between Java versions
LEFT, RIGHT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def yes_no(text: Column) -> Column:
    """First yes/no/true/false/y/n token as Yes or No; else by how the text starts; else empty."""
    def pick(s: Column) -> Column:
        return let(
            F.regexp_extract(s, LEFT + "(yes|no|true|false|y|n)" + RIGHT, 1),
            lambda token: F.when(token.isin("yes", "y", "true"), "Yes")
            .when(token.isin("no", "n", "false"), "No")
            .when(s.startswith("yes"), "Yes")
            .when(s.startswith("no"), "No")
            .otherwise(""),
        )

    return let(F.lower(F.trim(blank(text))), pick)


def option_letter(text: Column, letters: str) -> Column:
    """Letter after ANSWER / FINAL / OPTION, else a lone letter, else the first one anywhere."""
    def stages(s: Column) -> Column:
        named = F.regexp_extract(s, rf"(ANSWER|FINAL|OPTION)\s*[:\-]?\s*([{letters}])" + RIGHT, 2)
        lone = F.regexp_extract(s, LEFT + f"([{letters}])" + RIGHT, 1)
        # an empty match falls through to the next stage, which is only then evaluated
        return F.coalesce(F.nullif(named, F.lit("")), F.nullif(lone, F.lit("")), F.regexp_extract(s, f"([{letters}])", 1))

    return let(F.upper(F.trim(blank(text))), stages)


def option_letters(text: Column, letters: str) -> Column:
    """Distinct allowed letters in order of first use, comma-joined."""
    only = F.regexp_replace(F.upper(blank(text)), f"[^{letters}]", "")
    return F.array_join(F.array_distinct(F.filter(F.split(only, ""), lambda c: c != "")), ",")


def normalize_label(value: Column) -> Column:
    return F.lower(F.trim(value.cast("string")))


def normalize_label_list(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.upper(F.trim(v))), ",")


def answer_canonical(text: Column) -> Column:
    """Multi-answer text split at ; or , into upper-case parts, comma-joined."""
    parts = F.filter(F.transform(F.split(text, "[;,]"), lambda p: F.upper(F.trim(p))), lambda p: p != "")
    return F.array_join(parts, ",")


def label_parts(text: Column) -> Column:
    return F.filter(F.split(F.upper(blank(text)), r"[\s,;]+"), lambda p: p != "")


def task_kind(task: Column, type_id: Column, kind: Column) -> Column:
    return (
        F.when((task == 1) & ((type_id == 3) | (kind == "multi_mcq_opt_text")), "multi_mcq")
        .when((task == 1) & ((type_id == 4) | (kind == "yesno")), "yes_no")
        .when(task == 4, "yes_no").when(task == 10, "caption").when(task.isin(2, 11), "freeform")
        .otherwise("mcq")
    )


def answer_format(task: Column, type_id: Column, kind: Column) -> Column:
    low = F.lower(F.trim(blank(kind)))
    return (
        F.when((task == 1) & ((F.coalesce(type_id, F.lit(0)) == 4) | low.isin("yesno", "yn_opt_none")), "yes_no")
        .when(task == 4, "yes_no").when(task.isin(1, 3, 5, 6, 7, 8, 9), "mcq").when(task == 10, "caption")
        .when(task == 11, "open_short").when(task == 2, "long_report").otherwise("unknown")
    )


def normalize_prediction(answer: Column, kind: Column, allowed: Column) -> Column:
    """By kind: allowed letters in order (multi), first allowed letter (mcq), Yes/No, or the trimmed text."""
    first = F.trim(F.get(F.split(blank(answer), "\r?\n"), F.lit(0)))
    multi = F.array_distinct(F.filter(F.split(F.upper(blank(answer)), ""), lambda c: F.array_contains(allowed, c)))
    head = F.get(F.filter(F.split(F.upper(first), ""), lambda c: F.array_contains(allowed, c)), F.lit(0))
    lone = F.regexp_extract(F.upper(blank(answer)), LEFT + "([A-G])" + RIGHT, 1)
    mcq = F.coalesce(head, F.when(F.array_contains(allowed, lone), lone), F.upper(F.substring(first, 1, 1)))
    low = F.lower(blank(answer))
    yn = (
        F.when(low.rlike(LEFT + "yes" + RIGHT), "Yes").when(low.rlike(LEFT + "no" + RIGHT), "No")
        .otherwise(F.regexp_replace(first, "[.,!?;:]+$", ""))
    )
    return (
        F.when(kind == "multi_mcq", F.array_join(multi, ",")).when(kind == "mcq", mcq).when(kind == "yes_no", yn)
        .otherwise(F.trim(blank(answer)))
    )


def acceptance(pred: Column, kind: Column, labels: Column, confidence: Column, floor: float) -> Column:
    """``accepted`` or the reason of the first failed check."""
    wrong = F.concat(F.lit("invalid_label_not_in_"), F.array_join(labels, ","))
    parts = label_parts(pred)
    return (
        F.when(blank(pred) == "", "empty_prediction")
        .when((kind == "multi_mcq") & (F.size(parts) == 0), "empty_prediction")
        .when((kind == "multi_mcq") & (F.size(F.array_except(parts, labels)) > 0), wrong)
        .when((kind != "multi_mcq") & (F.size(labels) > 0) & ~F.array_contains(labels, pred), wrong)
        .when(kind.isin("caption", "freeform") & (F.length(F.trim(pred)) < 3), "freeform_too_short")
        .when(confidence < floor, f"confidence_below_{floor}")
        .otherwise("accepted")
    )


def clean_answer(text: Column) -> Column:
    """Text of the last assistant turn: after the last start marker, before the end markers."""
    s = blank(text)
    for marker in ("<|im_start|>assistant", "assistant\n"):
        s = F.element_at(F.split(s, f"\\Q{marker}\\E"), -1)
    for marker in ("<|im_end|>", "</s>"):
        s = F.substring_index(s, marker, 1)
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def after_think(text: Column) -> Column:
    """Everything behind the first closing think tag, empty without one."""
    at = F.locate("</think>", text)
    return F.when(at == 0, "").otherwise(F.regexp_replace(F.substr(text, at + 8), r"^\s+|\s+$", ""))


def clean_label(text: Column) -> Column:
    s = F.translate(F.lower(F.trim(text.cast("string"))), "_-", "  ")
    return F.regexp_replace(F.replace(s, F.lit("urbun"), F.lit("urban")), r"\s+", " ")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def parse_options(text: Column) -> Column:
    """``A. x B) y C: z`` as a map of letter to option; NULL when nothing can be read. A repeated letter keeps its last option."""
    mark = LEFT + r"([A-Z])[.):]\s*"

    def build(pairs: Column) -> Column:
        last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
        return F.when(F.size(pairs) > 0, F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], F.trim(p["v"])))))

    def zipped(parts: Column) -> Column:
        keys = F.regexp_extract_all(text, F.lit(mark), F.lit(1))
        bodies = F.slice(parts, F.lit(2), F.size(parts))
        return F.filter(F.arrays_zip(keys.alias("k"), bodies.alias("v")), lambda p: F.trim(p["v"]) != "")

    return let(let(F.split(text, mark), zipped), build)


def answer_key(options: Column, candidates: Sequence[Column]) -> Column:
    """Option letter of the first candidate that is a letter or equals an option's cleaned text."""

    def resolve(c: Column) -> Column:
        up = F.upper(F.trim(c))
        by_text = F.get(F.filter(F.map_entries(options), lambda e: clean_label(e["value"]) == clean_label(c)), F.lit(0))
        return F.when(F.map_contains_key(options, F.coalesce(up, F.lit(""))), up).otherwise(by_text["key"])

    return F.coalesce(*[resolve(c) for c in candidates])


SCORES = "struct<method:string,scores:map<string,double>>"


def parse_scores(raw: Column) -> Column:
    """Option log-probabilities, or NULL unless the method is logprob and all scores are finite."""

    def checked(p: Column) -> Column:
        ok = (
            (p["method"] == "logprob")
            & (F.size(p["scores"]) > 0)
            & F.forall(F.map_values(p["scores"]), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        )
        return F.when(ok, p["scores"])

    return let(F.from_json(raw, SCORES), checked)


def _split_scores(scores: Column, target: Column) -> Column:
    """Scores with the target's label and the others, by normalised label."""
    t = normalize_label(target)

    def values(e: Column, same: bool) -> Column:
        kept = F.filter(e, lambda x: (normalize_label(x["key"]) == t) if same else (normalize_label(x["key"]) != t))
        return F.transform(kept, lambda x: x["value"])

    return let(F.map_entries(scores), lambda e: F.struct(values(e, True).alias("hit"), values(e, False).alias("wrong")))


def option_nll(scores: Column, target: Column) -> Column:
    """log-sum-exp of all scores minus the target's; NULL unless exactly one label matches."""

    def total(values: Column) -> Column:
        return let(F.array_max(values), lambda top: top + F.log(F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp(v - top))))

    return let(
        _split_scores(scores, target),
        lambda m: F.when(F.size(m["hit"]) == 1, total(F.concat(m["hit"], m["wrong"])) - F.get(m["hit"], F.lit(0))),
    )


def margin_loss(scores: Column, target: Column) -> Column:
    """Best wrong score minus the right one."""
    return let(
        _split_scores(scores, target),
        lambda m: F.when((F.size(m["hit"]) == 1) & (F.size(m["wrong"]) > 0), F.array_max(m["wrong"]) - F.get(m["hit"], F.lit(0))),
    )


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(blank(text)), "[^a-z0-9]+", " "), " "), lambda t: t != "")


def duration_seconds(text: Column) -> Column:
    """Sum of all ``<number><h|m|s>`` parts."""
    pattern = F.lit(r"(\d+(?:\.\d+)?)\s*([hms])")
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, pattern, F.lit(1)).alias("v"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("u")
    )
    scale = F.create_map(F.lit("h"), F.lit(3600.0), F.lit("m"), F.lit(60.0), F.lit("s"), F.lit(1.0))
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["v"].cast("double") * scale[p["u"]])


def json_object(text: Column, schema: str) -> Column:
    """First-to-last brace of a free text as a struct."""
    return F.from_json(F.regexp_extract(blank(text), r"(?s)(\{.*\})", 1), schema)


def render_prompt(question: Column, options: Column) -> Column:
    lines = F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return F.when(
        F.coalesce(F.size(options), F.lit(0)) < 1,
        F.concat(blank(question), F.lit("\n\nProvide a concise answer based on the image.")),
    ).otherwise(F.concat(blank(question), F.lit("\n\nOptions:\n"), lines, F.lit("\n\nAnswer with just the letter.")))


def norm_path(path: Column, root: str) -> Column:
    """Absolute paths stay; ``./x`` and ``x`` are put under the root; empty stays NULL."""
    rel = F.regexp_replace(path, r"^\./", "")
    return F.when(blank(path) == "", None).when(path.startswith("/"), path).otherwise(F.concat(F.lit(root + "/"), rel))


IMAGE_NAME = r"(?i)\.(jpg|jpeg|png|bmp|webp|tif|tiff)$"  # fixed list of image suffixes


def absolutize_options(options: Column, root: str) -> Column:
    """Option values that look like image paths are resolved; others stay."""
    return F.transform_values(
        options, lambda k, v: F.when(v.startswith("./images/") | v.rlike(IMAGE_NAME), norm_path(v, root)).otherwise(v)
    )


def image_refs(*paths: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*paths)))


def uncertainty(logits: Column, top: int = 50) -> Column:
    """Largest logits, largest softmax probability and log-sum-exp energy of a stored logits array."""
    peak = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, v: s + F.exp(v - peak))
    return F.struct(
        F.slice(F.sort_array(logits, asc=False), 1, top).alias("top"), (1.0 / total).alias("max_prob"), (peak + F.log(total)).alias("energy")
    )
