"""Expressions on mapping strings: tokens, qualifiers, rendering, predicates, first-match inference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import blank


def variable_tokens(expression: Column) -> Column:
    """Variable names of a compound, conditional or assigned expression, in order, each once."""
    parts = F.split(blank(expression), r"[|/;]")
    bare = F.transform(parts, lambda p: F.trim(F.regexp_extract(F.regexp_replace(p, r"\s(?:if|IF|when|WHEN)\s.*$", ""), r"^\s*([^=]*)", 1)))
    return F.array_distinct(F.filter(F.transform(bare, lambda p: F.upper(p)), lambda p: p.rlike("^[A-Z][A-Z0-9_]*$")))


def qnam(expression: Column) -> Column:
    """The name after ``QNAM =``, without quotes; '' if there is none."""
    return F.upper(F.regexp_extract(blank(expression), r"(?i)\bQNAM\s*=\s*[\"']?([A-Za-z][A-Za-z0-9_]*)", 1))


def condition(expression: Column) -> Column:
    """What stands behind ``when`` or ``if``."""
    return F.trim(F.regexp_extract(blank(expression), r"(?i)\s(?:when|if)\s+(.*)$", 1))


def clean_expression(c: Column) -> Column:
    """White space to one blank, blanks around = and | off, capitals."""
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(blank(c), r"(?U)\s+", " "), r" ?([=|/]) ?", "$1")))


def base_domain(c: Column) -> Column:
    """A domain code in capitals without a SUPP in front."""
    return F.regexp_replace(F.upper(F.trim(blank(c))), "^SUPP", "")


def render(variable: Column, condition_: Column, supp: Column) -> Column:
    """``VAR``, ``VAR when C``, or ``QVAL when QNAM = "X"`` for a qualifier."""
    quoted = F.concat(F.lit('QVAL when QNAM = "'), supp, F.lit('"'))
    return F.when(blank(supp) != "", quoted).when(blank(condition_) != "", F.concat_ws(" when ", variable, condition_)).otherwise(blank(variable))


def status(sent: Column, mapped: Column) -> Column:
    """not_submitted before mapped before unmapped."""
    return F.when(~F.coalesce(sent, F.lit(True)), "not_submitted").when(blank(mapped) != "", "mapped").otherwise("unmapped")


def illegal_name(c: Column) -> Column:
    """Over eight characters, or anything but capitals, digits and underscores with a letter in front."""
    return (F.length(blank(c)) > 8) | ~blank(c).rlike("^[A-Z][A-Z0-9_]*$")


def standard_shape(c: Column, suffixes: tuple[str, ...]) -> Column:
    """two letters and one of the known endings."""
    return blank(c).rlike(f"^[A-Z]{{2}}(?:{'|'.join(suffixes)})$")


def holds_any(c: Column, words: tuple[str, ...]) -> Column:
    """whether a text holds one of the words, whatever its case."""
    return F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.lower(blank(c)).contains(w))


def first_match(c: Column, rules: list[tuple[str, str]], otherwise: Column) -> Column:
    """The outcome of the first (word, outcome) that a text holds."""
    low = F.lower(blank(c))
    return F.coalesce(*[F.when(low.contains(word.lower()), F.lit(out)) for word, out in rules], otherwise)


def all_matches(c: Column, rules: list[tuple[str, str]]) -> Column:
    """All outcomes in the order of the rules, each once."""
    low = F.lower(blank(c))
    return F.array_distinct(F.array_compact(F.array(*[F.when(low.contains(word.lower()), F.lit(out)) for word, out in rules])))


def assembled(meaning: list[Column], context: list[Column]) -> Column:
    """The text for an embedding, with its meaning twice and its context once; blanks left out."""
    parts = [*meaning, *meaning, *context]
    return F.concat_ws(" ", *[F.when(F.trim(blank(p)) != "", F.trim(p)) for p in parts])


def source_label(origin: Column, derived: Column, page: Column) -> Column:
    """Derived, CRF with its page, or Assigned."""
    crf = F.concat_ws(" ", F.lit("CRF Page"), page.cast("string"))
    return F.when(F.coalesce(derived, F.lit(False)), "Derived").when(page.isNotNull(), crf).when(blank(origin) != "", origin).otherwise("Assigned")


def number_order(c: Column) -> Column:
    """Order by number where a text is one, texts last."""
    return c.try_cast("double").asc_nulls_last()


#: What parts a table's name into tokens, each in turn.
SEPARATORS = ("/", "-", "—", "(", "（", ")", "）")


def table_domain(c: Column, names: dict[str, str], keywords: list[tuple[str, str]], meanings: list[tuple[str, str]], codes: list[str]) -> Column:
    """The domain of a table's name, null if no rule knows it. The rules in order:

    its name (with or without blanks) in ``names`` (lower case to code); the first of ``keywords`` that it holds; a token of
    it in ``names``; the longest of ``meanings`` that it holds; the first of ``codes`` in its capitals; the first of ``names`` inside it. The lists are configuration, hundreds of entries at most.
    """
    said = F.trim(blank(c))
    low, high = F.lower(said), F.upper(said)
    known = F.create_map(*[F.lit(x) for item in names.items() for x in item]) if names else F.create_map().cast("map<string,string>")
    of = lambda t: F.try_element_at(known, t)
    holds = lambda rules: [F.when(low.contains(word), F.lit(code)) for word, code in rules if word]
    plain = F.replace(low, F.lit("）"), F.lit(")"))
    tokens = F.concat(F.array(low), *[F.transform(F.split(plain, f"\\Q{s}\\E"), lambda t: F.trim(t)) for s in SEPARATORS])
    token = of(F.get(F.filter(tokens, lambda t: (t != "") & of(t).isNotNull()), F.lit(0)))
    longest = sorted(meanings, key=lambda r: -len(r[0]))
    contained = [F.when(high.contains(code), F.lit(code)) for code in codes if code]
    found = F.coalesce(of(low), of(F.replace(low, F.lit(" "), F.lit(""))), *holds(keywords), token, *holds(longest), *contained, *holds(list(names.items())), F.lit(None).cast("string"))
    return F.when(said != "", found)
