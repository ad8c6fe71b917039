"""Rules for cards: layers of sources, structure, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of files and headings that the rules look for.
OBSERVED_FILES = ("visual-notes", "ai-transcript", "vision-notes", ".vision.md", "multimodal-transcript", ".visual.md")
OBSERVED_LOCATOR = r"(?i)(?:source_locator|出处|语料|来源|corpus)[^\n]{0,140}(?:visual-notes|ai-transcript|vision-notes|multimodal-transcript|\.vision\.md)"
EXECUTION = r"(?m)^#+\s*E\s*[—-]\s*(?:Execution|可执行步骤)"
BOUNDARY = r"(?m)^#+\s*B\s*[—-]\s*(?:Boundary|边界)"
STATUS_SECTION = r"(?m)^#{1,4}[ \t]*(?:来源状态|声明溯源|claim[ _-]status)[^\n]*$"
STATUS_LINE = r"^\s*[-*]\s*\[(?:原文|通法|本卡规则)\]\s*\S"
SOURCES = r"(?m)source_locator|source_book|source_chapter|source_manifest|素材来源|^#{1,4}\s*来源"
NOT_FOR = "不做|不适用|不要用于|不用于"
DONE_WHEN, FAILURE_MODES = "完成标准", "失败模式"
PERSON = r"(?m)^(?:subject_type|material_type):[ \t]*person[ \t]*$"
PERSON_OPENING = "你不是在模仿语气"
PERSON_SECTION = r"(?m)^#{1,4}\s*我看问题的方式[^\n]*$([\s\S]*?)(?=^#{1,4}\s|\z)"
PERSON_STEP = r"(?im)^\s*(?:step\s*\d|第[一二三四五六七八九十]+步\s*[:：]|\d+\.\s)"
PERSON_PARTS = {"no_beliefs": "信念及其来源", "no_limits": "我明确不懂的", "no_tension": "内在矛盾", "no_red_lines": "我绝不会做的事"}
FIRST_HAND = r"\[一手\]|一手来源合计权重|coverage"
HEAD_CHARS, DESCRIPTION_CHARS, MOST_STEPS = 4000, 40, 6


def layer(text: Column, name: Column, marker: str = "SOURCE_LAYER") -> Column:
    """verbatim, user-supplied or ai-observation, by a marker line in the first 4000 characters, a JSON field or the file's name.

    ``marker`` is the word that the corpus at hand uses for its marker lines; set it to match.
    """
    head = F.substring(F.coalesce(text, F.lit("")), 1, HEAD_CHARS)
    marked = F.regexp_extract(head, rf"(?m)^\s*(?:<!--|#|//|/\*)?\s*{marker}\s*:\s*(ai-observation|user-supplied)\b", 1)
    hinted = F.lit(False)
    for hint in OBSERVED_FILES:
        hinted = hinted | F.coalesce(F.lower(name).contains(hint), F.lit(False))
    return F.when(marked != "", marked).when(head.rlike(r'"layer"\s*:\s*"ai-observation"') | hinted, "ai-observation").otherwise("verbatim")


def layer_violations(corpora: DataFrame, cards: DataFrame, marker: str = "SOURCE_LAYER") -> DataFrame:
    """(name, violation): corpora and cards that are observations, and cards that cite such a file."""
    bad = corpora.select("name", layer(F.col("text"), F.col("name"), marker).alias("layer")).filter("layer = 'ai-observation'").select("name", F.lit("corpus").alias("violation"))
    marked = layer(F.regexp_replace("text", r'"layer"', ""), F.lit(""), marker) == "ai-observation"
    found = F.array_compact(F.array(F.when(marked, "card"), F.when(F.col("text").rlike(OBSERVED_LOCATOR), "locator")))
    return bad.union(cards.select("name", F.explode(found).alias("violation")))


def guard_layers(corpora: DataFrame, cards: DataFrame, marker: str = "SOURCE_LAYER") -> None:
    """Raises if there is any violation; for the start of a check."""
    first = layer_violations(corpora, cards, marker).limit(1).collect()
    if first:
        raise ValueError(f"{first[0].name}: an observation is no source to check against ({first[0].violation})")


def card_rules(cards: DataFrame) -> DataFrame:
    """(name, level, rule) of what is wrong with cards (name, text with front matter)."""
    text = F.coalesce("text", F.lit(""))
    matter = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)
    body = F.regexp_replace(text, r"(?s)^---\n.*?\n---\n?", "")
    rows = cards.select("name", F.trim(F.regexp_extract(matter, r"(?m)^name:[ \t]*(.*)$", 1)).alias("slug"), F.trim(F.regexp_extract(matter, r"(?m)^description:[ \t]*(.*)$", 1)).alias("about"), matter.alias("matter"), body.alias("body"))
    section = F.when(F.col("body").rlike(STATUS_SECTION), F.regexp_extract("body", STATUS_SECTION + r"([\s\S]*?)(?=^#{1,4}\s|\z)", 1))
    claims = F.filter(F.split(section, "\n"), lambda x: x.rlike(r"^\s*[-*]\s+\S"))
    b, has_steps = F.col("body"), F.col("body").rlike(EXECUTION)
    steps = F.regexp_count(b, F.lit(r"(?m)^\*\*Step\s*\d"))
    bounded, marked = b.rlike(BOUNDARY), section.isNotNull()
    named = F.col("matter").rlike(r"(?m)^(?:source_locator|source_book|source_chapter|material|material_type):[ \t]*\S")
    # what must hold, by level; a rule that says nothing about a card (null) is no violation
    table = {
        "error": {
            "no_name": F.col("slug") != "", "bad_name": (F.col("slug") == "") | F.col("slug").rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$"), "no_description": F.col("about") != "",
            "no_completion": ~has_steps | b.contains(DONE_WHEN), "no_failure_modes": ~(has_steps & bounded) | b.contains(FAILURE_MODES),
            "empty_claim_status": ~marked | (F.size(claims) > 0), "unmarked_claims": ~F.exists(claims, lambda x: ~x.rlike(STATUS_LINE)),
        },
        "warn": {
            "short_description": F.length("about") >= DESCRIPTION_CHARS, "no_exclusion": F.col("about").rlike(NOT_FOR), "no_execution": has_steps, "no_steps": ~has_steps | (steps > 0),
            "many_steps": ~has_steps | (steps <= MOST_STEPS), "no_boundary": ~has_steps | bounded, "no_source": b.rlike(SOURCES) | named, "no_claim_status": marked,
        },
    }
    found = F.array_compact(F.array(*[F.when(~holds, F.struct(F.lit(level).alias("level"), F.lit(name).alias("rule"))) for level, rules in table.items() for name, holds in rules.items()]))
    return rows.select("name", F.explode(found).alias("r")).select("name", "r.level", "r.rule")


def person_rules(cards: DataFrame) -> DataFrame:
    """(name, level, rule) of what is wrong with cards on persons (name, text); other cards have no rows.

    A card on a person opens with what it is not, has a way of seeing that is no list of steps, says its
    beliefs, limits, tensions and red lines, and how far its sources are first-hand.
    """
    text = F.coalesce("text", F.lit(""))
    rows = cards.select("name", F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1).alias("matter"), F.regexp_replace(text, r"(?s)^---\n.*?\n---\n?", "").alias("body")).filter(F.col("matter").rlike(PERSON))
    way = F.regexp_extract("body", PERSON_SECTION, 1)
    has_way = F.col("body").rlike(PERSON_SECTION)
    wrong = {"no_opening": ~F.col("body").contains(PERSON_OPENING), "no_way_of_seeing": ~has_way, "steps_as_way": has_way & way.rlike(PERSON_STEP)}
    wrong |= {rule: ~F.col("body").contains(part) for rule, part in PERSON_PARTS.items()}
    found = [F.when(bad, F.struct(F.lit("error").alias("level"), F.lit(rule).alias("rule"))) for rule, bad in wrong.items()]
    found.append(F.when(~F.col("body").rlike(FIRST_HAND), F.struct(F.lit("warn").alias("level"), F.lit("no_first_hand").alias("rule"))))
    return rows.select("name", F.explode(F.array_compact(F.array(*found))).alias("r")).select("name", "r.level", "r.rule")


def links(pages: DataFrame) -> DataFrame:
    """(path, target): relative links outside code, as written."""
    fence = r"(?ms)^\s*(?:```|~~~)[^\n]*\n.*?^\s*(?:```|~~~)\s*$"
    bare = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), fence, "\n"), r"`[^`\n]*`", " ")
    rows = pages.select("path", F.explode(F.regexp_extract_all(bare, F.lit(r"\[[^\]]*\]\(([^)]+)\)"), F.lit(1))).alias("raw"))
    rows = rows.select("path", F.get(F.split(F.trim("raw"), r"\s+"), 0).alias("t")).filter(~F.col("t").rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:|#)") & (F.col("t") != ""))
    return rows.select("path", F.get(F.split("t", "#"), 0).alias("target"))


def dead_links(pages: DataFrame, files: DataFrame) -> DataFrame:
    """(path, target, state): links that leave the root (escaping) or lead to no file (dead).

    A target counts from its page's folder; `.` and `..` are resolved by a fold over its parts.
    """
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    steps = F.split(F.concat(folder, F.col("target")), "/")
    up = lambda done: F.when(F.size(done) == 0, F.array(F.lit(".."))).when(F.get(done, 0) == "..", done).otherwise(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
    walk = lambda done, x: F.when(x.isin("", "."), done).when(F.get(done, 0) == "..", done).when(x == "..", up(done)).otherwise(F.concat(done, F.array(x)))
    rows = links(pages).withColumn("parts", F.aggregate(steps, F.array().cast("array<string>"), walk))
    escapes = F.col("target").startswith("/") | F.coalesce(F.get("parts", 0) == "..", F.lit(False))
    rows = rows.withColumn("escapes", escapes).withColumn("at", F.array_join("parts", "/"))
    folders = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))).alias("at"))
    missing = rows.filter("not escapes and at <> ''").join(folders.distinct(), "at", "left_anti").select("path", "target", F.lit("dead").alias("state"))
    return rows.filter("escapes").select("path", "target", F.lit("escaping").alias("state")).union(missing)
