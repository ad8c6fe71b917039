"""Metadata: version differences, dependencies, manifests, bundle rules, ratios and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def version_diff(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, change): additive, deletion, modified or unchanged, by hash of the text."""
    a = old.select(key, F.sha2(F.coalesce("text", F.lit("")), 256).alias("old_hash"))
    b = new.select(key, F.sha2(F.coalesce("text", F.lit("")), 256).alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "additive").when(F.col("new_hash").isNull(), "deletion").when(F.col("old_hash") != F.col("new_hash"), "modified").otherwise("unchanged")
    return a.join(b, key, "full").select(key, change.alias("change"))


def sections(cards: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, title, body) of texts (key, text) by their headings; what is before the first has the title ''; a repeated title is one section."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    parts = cards.select(key, F.posexplode(F.split(F.regexp_replace(text, r"(?m)^(#{1,6}[ \t]+\S)", "\u0001$1"), "\u0001")).alias("at", "part"))
    title = F.when(F.col("at") == 0, "").otherwise(F.trim(F.regexp_extract("part", r"^#{1,6}[ \t]+([^\n]*)", 1)))
    body = F.when(F.col("at") == 0, F.col("part")).otherwise(F.regexp_replace("part", r"^[^\n]*\n?", ""))
    rows = parts.select(key, "at", title.alias("title"), F.regexp_replace(body, r"^\s+|\s+\z", "").alias("body"))
    by = rows.groupBy(key, "title").agg(F.array_sort(F.collect_list(F.struct("at", "body"))).alias("b"))
    return by.select(key, "title", F.array_join(F.transform("b", lambda x: x["body"]), "\n").alias("body"))


def section_diff(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, title, change) of the sections of texts that are in both editions and differ: additive, deletion or modified."""
    both = version_diff(old, new, key).filter("change = 'modified'").select(key)
    side = lambda df, name: sections(df.join(both, key, "left_semi"), key).select(key, "title", F.xxhash64("body").alias(name))
    pairs = side(old, "x").join(side(new, "y"), [key, "title"], "full")
    change = F.when(F.col("x").isNull(), "additive").when(F.col("y").isNull(), "deletion").when(F.col("x") != F.col("y"), "modified")
    return pairs.select(key, "title", change.alias("change")).filter("change is not null")


def repaired(files: DataFrame) -> DataFrame:
    """(path, text, notes) of files (path, slug, text) that want mechanical repair: line ends, trailing blanks, final line end, name."""
    text = F.col("text")
    lf = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    ended = F.when((lf != "") & ~lf.endswith("\n"), F.concat(lf, F.lit("\n"))).otherwise(lf)
    trimmed = F.regexp_replace(ended, r"[ \t]+\n", "\n")
    name = F.trim(F.regexp_extract(trimmed, r"(?s)\A---\n(?:.*?\n)??name:[ \t]*([^\n]*)\n.*?---", 1))
    wrong = F.coalesce((name != "") & (name != F.col("slug")), F.lit(False))
    # replaces the first line of that name, which is in the front matter
    named = F.when(wrong, F.regexp_replace(trimmed, F.lit(r"(?s)\A(---\n(?:.*?\n)??name:)[^\n]*"), F.concat(F.lit("$1 "), F.col("slug")))).otherwise(trimmed)
    notes = F.array_compact(F.array(F.when(text.contains("\r\n"), "line_ends"), F.when(lf != ended, "final_line_end"), F.when(ended != trimmed, "trailing_blanks"), F.when(wrong, "name")))
    return files.select("path", named.alias("text"), notes.alias("notes")).filter(F.size("notes") > 0)


def patched(cards: DataFrame, patches: DataFrame) -> DataFrame:
    """(card, text, state): cards (card, text) with patches (card, kind, name, content): set a field, replace or append a section.

    A field that is not there is added at the end of the front matter; a section to replace that is
    not there leaves the card as it is, with state ``no_section``.  One patch for each card.
    """
    text, name, content = F.col("text"), F.col("name"), F.trim("content")
    quoted = F.concat(F.lit("\\Q"), name, F.lit("\\E"))
    field = F.concat(F.lit(r"(?m)\A(---\n(?:[^\n]*\n)*?)"), quoted, F.lit(r":[^\n]*$"))
    line = F.concat(name, F.lit(": "), content)
    safe = lambda x: F.regexp_replace(x, r"([\\$])", r"\\$1")
    with_field = F.when(F.regexp_like(text, field), F.regexp_replace(text, field, F.concat(F.lit("$1"), safe(line)))).otherwise(F.regexp_replace(text, F.lit(r"\A(---\n(?:[^\n]*\n)*?)---"), F.concat(F.lit("$1"), safe(line), F.lit("\n---"))))
    section = F.concat(F.lit(r"(?m)^(#{1,4}\s+"), quoted, F.lit(r"[^\n]*)$[\s\S]*?(?=^#{1,4}\s|\z)"))
    there = F.regexp_like(text, section)
    with_section = F.regexp_replace(text, section, F.concat(F.lit("$1\n\n"), safe(content), F.lit("\n\n")))
    appended = F.concat(F.regexp_replace(text, r"\s+\z", ""), F.lit("\n\n## "), name, F.lit("\n\n"), content, F.lit("\n"))
    kind = F.col("kind")
    new = F.when(kind == "field", with_field).when((kind == "replace") & there, with_section).when(kind == "append", appended).otherwise(text)
    state = F.when(kind.isNull(), "unchanged").when((kind == "replace") & ~there, "no_section").otherwise("patched")
    return cards.join(patches, "card", "left").select("card", new.alias("text"), state.alias("state"))


def dependencies(relations: DataFrame, cards: DataFrame) -> DataFrame:
    """Each relation as an edge to a known card, or as an orphan."""
    known = cards.select(F.col("slug").alias("target"), F.lit(True).alias("known")).distinct()
    return relations.join(known, "target", "left").select("slug", "target", "relation", F.when(F.col("known"), "edge").otherwise("orphan").alias("state"))


def impact(relations: DataFrame, slug: str) -> DataFrame:
    return relations.filter(F.col("target") == slug).select("slug").distinct()


def manifest_drift(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Files of a manifest that are missing or differ."""
    both = manifest.join(files.select("path", F.col("hash").alias("now")), "path", "left")
    state = F.when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("hash"), "changed")
    return both.select("path", state.alias("state")).filter("state is not null")


def bundle_rules(cards: DataFrame) -> DataFrame:
    """(slug, rule) of every violation: duplicate slug, bad slug, missing or short description, path out of the bundle."""
    short = F.length(F.coalesce("description", F.lit("")))
    rules = F.array_compact(F.array(F.when(~F.col("slug").rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$"), "bad_slug"), F.when(short == 0, "no_description").when(short < 40, "short_description"), F.when(F.col("src").rlike(r"^/|(^|/)\.\.(/|$)"), "escaping_src")))
    own = cards.select("slug", F.explode(rules).alias("rule"))
    twice = cards.groupBy("slug").agg(F.count("*").alias("n")).filter("n > 1").select("slug", F.lit("duplicate_slug").alias("rule"))
    return own.union(twice)


def missing_parts(cards: DataFrame, files: DataFrame, required: tuple[str, ...] = ("slug", "description", "src")) -> DataFrame:
    """(slug, rule) of cards without a required field, or whose src is no file (``missing_file``) or is a link (``link``): files (path, is_link)."""
    rules = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", f"no_{c}") for c in required]))
    bare = cards.select("slug", F.explode(rules).alias("rule"))
    both = cards.filter("coalesce(src, '') <> ''").join(files.select(F.col("path").alias("src"), "is_link"), "src", "left")
    state = F.when(F.col("is_link").isNull(), "missing_file").when(F.col("is_link"), "link")
    return bare.union(both.select("slug", state.alias("rule")).filter("rule is not null"))


def stated_ratio(text: Column) -> Column:
    """The share of first-hand sources that a text states, else that of its marks; null without either."""
    said = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (r"一手来源合计权重[：:]\s*([0-9]+(?:\.[0-9]+)?)", r"one_hand_ratio[：:]\s*([0-9]+(?:\.[0-9]+)?)")])
    return F.coalesce(said.cast("double"), source_ratio(text))


def source_ratio(text: Column) -> Column:
    """The share of first-hand marks among all marks, null without any."""
    first, second = F.regexp_count(text, F.lit(r"\[一手\]")), F.regexp_count(text, F.lit(r"\[二手\]"))
    return F.when(first + second > 0, first / (first + second))


def use_cases(text: Column, most: int = 4) -> Column:
    """Up to ``most`` distinct uses (4 to 100 characters) of a description, without list marks; exclusions are no uses."""
    parts = F.transform(F.split(text, "[。；;]|适用于：|适用："), lambda x: F.regexp_replace(x, r"(?U)^\s*[-*• ]*\s*|\s+$", ""))
    is_use = lambda x: F.length(x).between(4, 100) & ~F.lower(x).rlike("^(english|不做|不适用|不用于)")
    return F.slice(F.array_distinct(F.filter(parts, is_use)), 1, most)
