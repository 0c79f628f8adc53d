"""Column functions over names and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark import schema as S


def strip(x: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalize_entity(name: Column) -> Column:
    """Lower case, stripped, and without a trailing ", the ..." appositive."""
    return strip(F.regexp_replace(strip(F.lower(name)), r"(?U),\s*the\s+[^\n]+$", ""))


def tokens(x: Column) -> Column:
    """Words between white space; none for a blank name."""
    return F.filter(F.split(strip(x), r"(?U)\s+"), lambda t: t != "")


def is_canonical(relation: Column) -> Column:
    return relation.isin(*S.CANONICAL_RELATIONS)


def is_symmetric(relation: Column) -> Column:
    return relation.isin(*S.SYMMETRIC_RELATIONS)


def is_pronoun_generic(name: Column) -> Column:
    last = F.lower(F.element_at(tokens(name), -1))
    words = [*S.PRONOUN_GENERIC, *S.IRREGULAR_FORMS, *S.ARCHAIC_FORMS]
    plural = last.endswith("s") & F.regexp_replace(last, "s$", "").isin(*S.PRONOUN_GENERIC)
    return F.when(F.size(tokens(name)) == 0, F.lit(False)).otherwise(last.isin(*words) | plural)


def is_nameable(name: Column) -> Column:
    """Whether a question could name the entity: one to four words, no leading function word, no pronoun or role."""
    words = tokens(name)
    return (
        F.size(words).between(1, 4)
        & ~F.coalesce(F.lower(F.get(words, F.lit(0))).isin(*S.LEADING_FUNCTION_WORDS), F.lit(False))
        & ~is_pronoun_generic(name)
        & ~F.lower(name).isin(*S.SOCIAL_ROLES)
    )


def is_nameable_old(name: Column) -> Column:
    """The earlier predicate, an arm of comparisons: of one to four words, by first word and whole name as they are written."""
    words = tokens(name)
    first = F.coalesce(F.get(words, F.lit(0)).isin(*S.OLD_FUNCTION_WORDS), F.lit(False))
    return F.size(words).between(1, 4) & ~first & ~name.isin(*S.OLD_GENERIC)


def mentions_word(text: Column, name: Column) -> Column:
    """Whether a name stands in a text between word boundaries, in any case."""
    return F.regexp_instr(F.lower(text), F.concat(F.lit("(?U)\\b\\Q"), F.lower(name), F.lit("\\E\\b"))) > 0


def core_tokens(name: Column) -> Column:
    """Distinct words without titles and articles."""
    return F.array_except(tokens(F.lower(name)), F.array(*map(F.lit, S.HONORIFICS)))


def differs_only_by_suffix(a: Column, b: Column) -> Column:
    """Whether the words in one name but not the other are all suffixes like "jr", and there are some."""
    x, y = tokens(F.lower(a)), tokens(F.lower(b))
    apart = F.array_union(F.array_except(x, y), F.array_except(y, x))
    return (F.size(apart) > 0) & (F.size(F.array_except(apart, F.array(*map(F.lit, S.DISTINGUISHING_SUFFIXES)))) == 0)


def is_variant_pair(a: Column, b: Column) -> Column:
    """Whether one name's core words contain the other's, or two at least are shared."""
    x, y = core_tokens(a), core_tokens(b)
    shared = F.size(F.array_intersect(x, y))
    return (F.size(x) > 0) & (F.size(y) > 0) & ((shared == F.least(F.size(x), F.size(y))) | (shared >= 2))


def predicate(relation: Column) -> Column:
    """What stands between the names; null for relations without a template."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in S.PREDICATES.items() for x in kv)), relation)


def sentence(entity1: Column, entity2: Column, relation: Column) -> Column:
    return F.concat(entity1, F.lit(" "), F.coalesce(predicate(relation), F.regexp_replace(relation, "_", " ")), F.lit(" "), entity2)


def question_forward(entity: Column, relation: Column) -> Column:
    """The question for the second entity of a relation, given the first; null without a template."""
    p = predicate(relation)
    return F.when(relation == "travel_to", F.concat(F.lit("Where does "), entity, F.lit(" travel to?"))).otherwise(
        F.concat(F.lit("Who "), F.substring_index(p, " ", 1), F.lit(" "), entity, F.lit(" "), F.regexp_replace(p, "^[a-z]+ ", ""), F.lit("?"))
    )


def question_reverse(entity: Column, relation: Column) -> Column:
    """The question for the first entity, given the second; null without a template."""
    return F.concat(F.lit("Who "), predicate(relation), F.lit(" "), entity, F.lit("?"))


def name_shape(name: Column) -> Column:
    """title, particle, multiword or plain."""
    return (
        F.when(name.rlike(S.TITLE_PATTERN), "title")
        .when(name.rlike(S.PARTICLE_PATTERN), "particle")
        .when(F.size(tokens(name)) >= 3, "multiword")
        .otherwise("plain")
    )


def guess_language(text: Column) -> Column:
    """The language whose stop words show at least four times, French before German before Spanish, else English."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-zà-ÿ]+)"), 1))
    n = {k: F.size(F.array_intersect(words, F.array(*map(F.lit, v)))) for k, v in S.LANGUAGE_MARKERS.items()}
    fr, de, es = n["french"], n["german"], n["spanish"]
    return (
        F.when((fr >= 4) & (fr >= de) & (fr >= es), "likely_french")
        .when(de >= 4, "likely_german")
        .when(es >= 4, "likely_spanish")
        .otherwise("likely_english")
    )
