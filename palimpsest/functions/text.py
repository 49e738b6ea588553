"""Text expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters on which Python's ``str.split()`` splits.  Unicode white space plus
# the four separators; written as a class property, which matches faster than a list of ranges.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"


def tokenize(text: Column) -> Column:
    """Lower-cased whitespace tokens, empties dropped."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WHITESPACE), "")


def entity_doc_text(name: Column, summary: Column) -> Column:
    return F.concat(name, F.lit(" "), F.coalesce(summary, F.lit("")))


def episode_doc_text(content: Column, sessions: Column) -> Column:
    """Content followed by every non-empty saved memory of every run."""
    saved = F.transform(F.flatten(F.map_values(sessions)), lambda run: run["llm_saved_memory"])
    kept = F.filter(saved, lambda m: m.isNotNull() & (m != ""))
    return F.concat_ws(" ", content, F.array_join(F.coalesce(kept, F.array().cast("array<string>")), " "))


def normalize_entity_name(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def normalize_type(name: Column) -> Column:
    return F.replace(F.upper(name), F.lit(" "), F.lit("_"))


def clean_embed_text(text: Column) -> Column:
    """Newlines become spaces, ends trimmed; an empty result embeds as the zero vector."""
    return F.trim(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")))


def entity_embed_text(name: Column, entity_type: Column) -> Column:
    return F.concat(name, F.lit(" ("), entity_type, F.lit(")"))


def content_key(*parts: Column) -> Column:
    """A stable key for "the same content"; shuffles carry it in place of whole texts."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def overlap_hits(query: Column, pattern: Column) -> Column:
    """How many of the query's words (repeats count) occur in the pattern.

    The intersection hashes each list once; only shared words are then counted in the query.
    """
    shared = F.transform(F.array_intersect(query, pattern), lambda w: F.size(F.filter(query, lambda x: x == w)))
    return F.aggregate(shared, F.lit(0), lambda acc, n: acc + n)


def token_overlap(query: Column, pattern: Column, min_chars: int = 0) -> Column:
    """Query tokens found in ``pattern`` (repeats count) over the longer of the two lists."""
    def words(c: Column) -> Column:
        toks = tokenize(c)
        return F.filter(toks, lambda w: F.length(w) > min_chars) if min_chars else toks

    def ratio(pair: Column) -> Column:
        q, p = pair["q"], pair["p"]
        longest = F.greatest(F.size(q), F.size(p))
        return F.when(longest > 0, overlap_hits(q, p) / longest).otherwise(F.lit(0.0))

    # A lambda over one element binds the token lists, so that they are computed once per row.
    one = F.array(F.struct(words(query).alias("q"), words(pattern).alias("p")))
    return F.element_at(F.transform(one, ratio), 1)


def contains_ci(haystack: Column, needle: str) -> Column:
    return F.contains(F.lower(haystack), F.lit(needle.lower()))
