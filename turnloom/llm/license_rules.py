"""Licence recognition by sentence rules, in DataFrame expressions only.

Comment marks at the beginning of lines go, texts are cut into sentences (at marks before white space, at blank lines
and at ends of comments), each sentence is normalised and mapped to the identifier of a known licence sentence, and each text's sequence
of identifiers is matched against ordered rules: a rule's identifiers must follow one another, with nothing but
copyright notices or repeats between. Longer rules come first and use up what they match.

The known sentences and the rules are cut from published notices (license_notices) by the same splitting, so a rule is
the very sequence that its notice gives. A sentence that is not known as a whole may name licences ("licensed under the
..."); failing that its last line is tried, since headings often end without a mark. SPDX-License-Identifier lines add
the identifiers they list.

Defined results: null and empty texts have no sentences; texts without any word of GATE are not read further and get
an empty list, like texts without known sentences; texts with known sentences but no licence get "unknown"; repeated
rows are scanned each; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.license_notices import NAMES, NOTICES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ENDS = r"[.!?;:]+[ \t\r\n]+|\n[ \t\r]*\n[ \t\r\n]*|\*+/"
_OTHER = r"[^a-z0-9]+"
_COMMENT = r"(^|\n)[ \t]*(?:/+\*+|\*+/?|//+|#+|--+|;+|%+|dnl )"
_NOTICE = r"^(?:c )?copyright (?:c )?[0-9]{4}(?: |$)"
_SPDX = r"SPDX-License-Identifier:[ \t]*([^\r\n]*)"
GATE = r"(?i)licen[cs]|permission|redistribut|copyright|warrant|public domain|liab|gpl|wtfpl|cc0|cc[ -]by|spdx"
#: Shorter parts of notices ("this program is free software", "2 0") are too common or too varied to be known sentences.
_LEAST_WORDS = 6
_LEAD = r"(?:licen[cs]ed|released|distributed|available|provided|published|offered|dual licen[cs]ed) (?:to you )?(?:under|into) "


def fragments(text: str) -> list[str]:
    """The sentences of a text in normal form, as sentence_ids() cuts them."""
    parts = re.split(_ENDS, re.sub(_COMMENT, r"\1", text))
    return [re.sub(_OTHER, " ", p.translate(str.maketrans(_UPPER, _LOWER))).strip(" ") for p in parts]


def _tables() -> tuple[dict[str, str], list[tuple[str, tuple[str, ...]]]]:
    """Identifier by known sentence, and the rules, longest first."""
    known, rules = {}, []
    for licence, notice in NOTICES:
        stem, ids = re.sub(r"[^a-z0-9]+", "_", licence.lower()), []
        for part in fragments(notice):
            if part.count(" ") + 1 >= _LEAST_WORDS:
                name = known.setdefault(part, f"{stem}_{1 + len({x for x in known.values() if x.startswith(stem + '_')})}")
                ids.append(name)
                for scheme in ("http", "https"):
                    known.setdefault(re.sub(r"\bhttps?\b", scheme, part), name)
        rules.append((licence, tuple(ids)))
    return known, sorted(dict.fromkeys(rules), key=lambda r: -len(r[1]))


SENTENCES, RULES = _tables()
_BY_NAME = {name: licence for licence, names in NAMES.items() for name in names}
#: Licence identifiers that SPDX lines may list.
_DECLARED = sorted({licence for licence, _ in NOTICES} | set(NAMES))
_NAMED = r"(?:under|into|of|or|and) (?:either )?(?:of )?(?:the |an? )?(" + "|".join(sorted(_BY_NAME, key=len, reverse=True)) + ")(?: |$)"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _OTHER, " "))


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order.

    Copyright notices are "copyright"; a sentence that names licences has "by name " and the licence for each.
    """
    known, names = _map(SENTENCES), _map(_BY_NAME)

    def named(normal: Column) -> Column:
        found = F.transform(F.regexp_extract_all(normal, F.lit(_NAMED), F.lit(1)), lambda n: F.concat(F.lit("by name "), F.element_at(names, n)))
        return F.when(normal.rlike(_LEAD) & (F.size(found) > 0), found)

    def identifiers(sentence: Column) -> Column:
        whole = _normal(sentence)
        last = _normal(F.regexp_extract(sentence, r"[^\n]*$", 0))
        one = lambda x: F.when(x.isNotNull(), F.array(x))
        return F.coalesce(
            one(F.element_at(known, whole)), named(whole), one(F.element_at(known, last)), named(last),
            F.when(whole.rlike(_NOTICE), F.array(F.lit("copyright"))), F.array().cast("array<string>"),
        )

    plain = F.regexp_replace(text, _COMMENT, "$1")
    cut = F.flatten(F.transform(F.split(plain, _ENDS), identifiers))
    return F.when(text.rlike(GATE), cut).otherwise(F.array().cast("array<string>"))


def declared(text: Column) -> Column:
    """The known identifiers that SPDX lines of a text list."""
    listed = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_SPDX), F.lit(1)), lambda x: F.split(x, r"[ \t()*/]+")))
    return F.filter(listed, lambda x: x.isin(_DECLARED))


def _pattern(parts: tuple[str, ...]) -> str:
    """One rule in a sequence written as <a><b>: repeats and copyright notices may stand between."""
    return "(?:<copyright>)*".join(f"(?:<{p}>)+" for p in parts)


_USED = r"<copyright>|<by name [^>]*>|\|"


def licences(ids: Column, listed: Column) -> Column:
    """Sorted distinct licences of a sequence of identifiers and of what SPDX lines list."""
    rest = F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    found = []
    for licence, parts in RULES:
        found.append(F.when(rest.rlike(_pattern(parts)), F.lit(licence)))
        rest = F.regexp_replace(rest, _pattern(parts), "|")
    names = F.transform(F.filter(ids, lambda x: x.startswith("by name ")), lambda x: F.substring(x, 9, 99))
    every = F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*found)), names, listed)))
    left = F.regexp_replace(rest, _USED, "") != ""
    return F.when((F.size(every) == 0) & left, F.array(F.lit("unknown"))).otherwise(every)


def scanned(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, sentence_ids, licences."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<string>")
    listed = F.when(text.contains("SPDX-License-Identifier:"), declared(text)).otherwise(none)
    ids = documents.select("doc_id", sentence_ids(text).alias("sentence_ids"), listed.alias("listed"))
    some = F.when((F.size("sentence_ids") > 0) | (F.size("listed") > 0), licences(F.col("sentence_ids"), F.col("listed"))).otherwise(none)
    return ids.select("doc_id", "sentence_ids", some.alias("licences"))


def digest(result: DataFrame) -> DataFrame:
    """A result of scanned() with its lists as text."""
    return result.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def oracle_sql() -> str:
    """The same rows in DuckDB."""
    table = lambda pairs: ", ".join(f"'{a}': '{b}'" for a, b in pairs.items())
    normal = f"trim(regexp_replace(translate(%s, '{_UPPER}', '{_LOWER}'), '{_OTHER}', ' ', 'g'))"
    whole, last = normal % "s", normal % "regexp_extract(s, '[^\\n]*$')"
    tried = []
    for form in ("whole", "last"):
        tried.append(f"case when m[{form}] is not null then [m[{form}]] end")
        found = f"list_transform(regexp_extract_all({form}, '{_NAMED}', 1), lambda n: 'by name ' || names[n])"
        tried.append(f"case when regexp_matches({form}, '{_LEAD}') and len({found}) > 0 then {found} end")
    steps = [
        f"r{n} as (select r, case when regexp_matches(rest, '{_pattern(parts)}') then list_append(found, '{licence}') else found end as found, regexp_replace(rest, '{_pattern(parts)}', '|', 'g') as rest from {f'r{n - 1}' if n else 'joined'})"
        for n, (licence, parts) in enumerate(RULES)
    ]
    listed = ", ".join(f"'{x}'" for x in _DECLARED)
    return f"""
with d as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
known as (select map {{{table(SENTENCES)}}} as m, map {{{table(_BY_NAME)}}} as names),
cut as (select r, string_split_regex(regexp_replace(text, '{_COMMENT}', '\\1', 'g'), '{_ENDS}') as parts from d where regexp_matches(text, '{GATE}')),
sentences as (select r, unnest(parts) as s, unnest(generate_series(1, len(parts))) as i from cut),
forms as (select r, i, {whole} as whole, {last} as last from sentences),
told as (select r, i, coalesce({", ".join(tried)}, case when regexp_matches(whole, '{_NOTICE}') then ['copyright'] end) as x from forms, known),
ids as (select r, flatten(list(x order by i)) as sentence_ids from told where x is not null group by r),
joined as (select r, cast([] as varchar[]) as found, array_to_string(list_transform(sentence_ids, lambda x: '<' || x || '>'), '') as rest from ids),
{", ".join(steps)},
lists as (select d.r, doc_id, coalesce(sentence_ids, []) as sentence_ids, list_sort(list_distinct(list_concat(coalesce(found, []),
    list_transform(list_filter(coalesce(sentence_ids, []), lambda x: starts_with(x, 'by name ')), lambda x: substr(x, 9)),
    list_filter(flatten(list_transform(regexp_extract_all(text, '{_SPDX}', 1), lambda x: string_split_regex(x, '[ \\t()*/]+'))), lambda x: list_contains([{listed}], x))))) as names, rest
  from d left join ids using (r) left join r{len(RULES) - 1} using (r))
select doc_id, cast(len(sentence_ids) as bigint) as n_sentences, coalesce(array_to_string(sentence_ids, ' '), '') as sentence_ids,
  case when len(names) > 0 then array_to_string(names, ',') when regexp_replace(coalesce(rest, ''), '{_USED}', '', 'g') <> '' then 'unknown' else '' end as licences
from lists"""
