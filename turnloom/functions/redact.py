"""Redaction of credentials, in passes; each sees what the one before left.

Text passes are column expressions. Passes that decide by a name replace exactly the matches whose name is sensitive: the
text between matches and the matches themselves are put together again, so a harmless match uses up its value as well.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from turnloom.functions.text import WIDE_SPACE

MARK = "[REDACTED]"

# Sensitive names (letters and digits only, lower case), endings, and names of environments.
SENSITIVE = ("authorization", "clientsecret", "cookie", "credentials", "password", "passwd", "privatekey", "proxyauthorization", "secret", "setcookie", "signingkey", "token")
SENSITIVE_ENDS = ("apikey", "accesskey", "password", "privatekey", "secret", "token")
#: Every sensitive name has one of these once _ and - are gone.
STEMS = ("authorization", "secret", "cookie", "credentials", "passw", "privatekey", "signingkey", "token", "apikey", "accesskey", "proxyauth")
ENVIRONMENTS = ("env", "environment", "environmentvariables")

# The patterns, for Java and Python alike. _S is white space, _B where a word begins, _V a value.
_S = f"[{WIDE_SPACE}]"
_NS = f"[^{WIDE_SPACE}"
_B = "(?<![A-Za-z0-9_])"
UNQUOTED = f"{_NS};&|]+"
_V = f"(?:\"[^\"\r\n]*\"|'[^'\r\n]*'|{UNQUOTED})"
PEM = r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----[\s\S]*?-----END \1-----"
AUTHORIZATION = f"(?i)({_B}(?:authorization|proxy-authorization){_S}*:{_S}*)(?:Bearer|Basic){_S}+{_NS},;]+"
API_HEADER = f"(?i)({_B}(?:x-api-key|api-key|x-auth-token){_S}*:{_S}*){_NS},;]+"
FLAG = f"(?i)(--(?:api[-_]?key|access[-_]?token|auth[-_]?token|token|password|passwd|secret|client[-_]?secret|private[-_]?key))(=|{_S}+){_V}"
USER = f"(^|[{WIDE_SPACE};&|])(-u|--user)(=|{_S}+){_V}"
URI = f"(?i){_B}([a-z][a-z0-9+.-]*://)({_NS}/:@]+):({_NS}/@]+)@"
ASSIGNMENT = f"{_B}([A-Za-z_][A-Za-z0-9_]*)({_S}*={_S}*){_V}"
NAMED = (
    "(?:([\"'])([A-Za-z_][A-Za-z0-9_-]*)\\1|([A-Za-z_][A-Za-z0-9_-]{0,63}))"
    f"({_S}*:{_S}*)(\"[^\"\r\n]*\"|'[^'\r\n]*'|{_NS},;}}]+(?=[,;}}]|[\r\n]|$)|{_NS},;}}]*[0-9]{_NS},;}}]*)"
)
VENDOR = f"{_B}(?:sk-(?:proj-|svcacct-)?[A-Za-z0-9_-]{{12,}}|gh[pousr]_[A-Za-z0-9]{{20,}}|github_pat_[A-Za-z0-9_]{{20,}}|xox[baprs]-[A-Za-z0-9-]{{12,}}|AKIA[0-9A-Z]{{16}}|AIza[0-9A-Za-z_-]{{30,}})(?![A-Za-z0-9_])"
#: A sign that every match has, a pattern and what takes its place, for passes of one's own choice.
Rule = tuple[str, str, str]
_ASCII_SPACE = "\t\n\x0c\r "
ACCESS_KEY: Rule = ("AKIA", f"{_B}AKIA[0-9A-Z]{{16}}(?![A-Za-z0-9_])", MARK)
_VENDOR_SIGNS = ("sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "xox", "AKIA", "AIza")
_HEAD = f"^([\"']?)([A-Za-z_][A-Za-z0-9_-]*)\\1({_S}*[:=]{_S}*)"


def normal_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def is_sensitive(name: Column) -> Column:
    """Whether a value under this name must not be kept."""
    normal = normal_name(name)
    return normal.isin(*SENSITIVE) | normal.rlike(f"({'|'.join(SENSITIVE_ENDS)})$")


def replace_matches(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """Every match of the pattern replaced by what `change` makes of it."""
    gaps = F.split(text, pattern, -1)
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), change)
    return F.array_join(F.zip_with(gaps, matches, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")


def _by_name(match: Column) -> Column:
    """A match name-separator-value without the value if the name is sensitive."""
    head = F.regexp_extract(match, _HEAD, 0)
    return F.when(is_sensitive(F.regexp_extract(match, _HEAD, 2)), F.concat(head, F.lit(MARK))).otherwise(match)


def by_name(text: Column, pattern: str, sign: str) -> Column:
    """The pass of a named pattern alone, skipped where the text lacks the sign that every match has."""
    return _pass(text, _has(text, sign), lambda t: replace_matches(t, pattern, _by_name))


def _pass(text: Column, signed: Column, change: Callable[[Column], Column]) -> Column:
    """A pass, skipped where the text as it came lacks a sign that every match has. No pass adds a sign."""
    return F.get(F.transform(F.array(text), lambda x: F.when(signed, change(x)).otherwise(x)), 0)


def _has(text: Column, *signs: str) -> Column:
    found = [F.contains(text, F.lit(s)) for s in signs]
    return reduce(Column.__or__, found)


def _steps(x: Column, small: Column, named: Column) -> list[tuple[Column, Callable[[Column], Column]]]:
    """The passes in order, each with the sign that the text as it came must have: its lower case and whether it has a stem."""
    plain = lambda pattern, put: lambda t: F.regexp_replace(t, pattern, put)
    return [
        (_has(x, "-----BEGIN "), plain(PEM, "[REDACTED]")),
        (_has(small, "authorization"), plain(AUTHORIZATION, "$1[REDACTED]")),
        (_has(small, "api-key", "x-auth-token"), plain(API_HEADER, "$1[REDACTED]")),
        (_has(x, "--"), plain(FLAG, "$1$2[REDACTED]")),
        (_has(x, "-u"), plain(USER, "$1$2$3[REDACTED]")),
        (_has(x, "://"), plain(URI, "$1$2:[REDACTED]@")),
        (named & _has(x, "="), lambda t: replace_matches(t, ASSIGNMENT, _by_name)),
        (named & _has(x, ":"), lambda t: replace_matches(t, NAMED, _by_name)),
        (_has(x, *_VENDOR_SIGNS), plain(VENDOR, "[REDACTED]")),
    ]


def redact_text(text: Column) -> Column:
    """All passes over free text; null stays null. Searches for plain signs decide which passes a text needs.

    For one expression among others; for whole tables redacted() is several times faster.
    """

    def passes(x: Column) -> Column:
        small = F.lower(x)
        named = _has(F.translate(small, "_-", ""), *STEMS)
        for signed, change in _steps(x, small, named):
            x = _pass(x, signed, change)
        return x

    return F.get(F.transform(F.array(text), passes), 0)


def assigned(name: str, value: str = _V) -> Rule:
    """The rule of values assigned to one name as it is written, whatever stands before it; white space is that of ASCII."""
    return name, f"({name}[{_ASCII_SPACE}]*=[{_ASCII_SPACE}]*){value.replace(WIDE_SPACE, _ASCII_SPACE)}", f"$1{MARK}"


def redacted(rows: DataFrame, *names: str, rules: Sequence[Rule] | None = None) -> DataFrame:
    """rows with all passes over some text columns: the values of redact_text(). With rules, their passes alone, in order.

    The signs are columns of one projection and every pass is a column of its own, so all is compiled and a text is
    lower-cased and searched once.
    """
    columns = rows.columns
    for name in names:
        x = F.col(name)
        if rules is not None:
            rows = rows.withColumns({f"_redact_{i}": _has(x, sign) for i, (sign, _, _) in enumerate(rules)})
            for i, (_, pattern, put) in enumerate(rules):
                rows = rows.withColumn(name, F.when(F.col(f"_redact_{i}"), F.regexp_replace(x, pattern, put)).otherwise(x))
            continue
        rows = rows.withColumn("_redact_low", F.lower(x))
        rows = rows.withColumn("_redact_named", F.translate("_redact_low", "_-", "").rlike("|".join(STEMS)))
        steps = _steps(x, F.col("_redact_low"), F.col("_redact_named"))
        rows = rows.withColumns({f"_redact_{i}": signed for i, (signed, _) in enumerate(steps)})
        for i, (_, change) in enumerate(steps):
            rows = rows.withColumn(name, F.when(F.col(f"_redact_{i}"), change(x)).otherwise(x))
    return rows.select(*[F.col(f"`{c.replace('`', '``')}`") for c in columns])


#: Patterns by rule; named rules count matches whatever the name.
RULES = {"pem": PEM, "authorization": AUTHORIZATION, "api_header": API_HEADER, "flag": FLAG, "user": USER, "uri": URI, "vendor": VENDOR}


def sensitive_matches(text: Column, pattern: str) -> Column:
    """How many matches of a named pattern have a sensitive name."""
    names = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.regexp_extract(m, _HEAD, 2))
    return F.size(F.filter(names, is_sensitive))


def redaction_report(rows: DataFrame, text: str, *keys: str, patterns: Mapping[str, str] | None = None) -> DataFrame:
    """Per group: rows, bytes, rows that redaction changes, and matches of each rule (of sensitive names for named rules).

    With patterns by name, their matches alone.
    """
    counts = {name: F.regexp_count(F.col(text), F.lit(p)) for name, p in (RULES if patterns is None else patterns).items()}
    if patterns is None:
        counts |= {"assignment": sensitive_matches(F.col(text), ASSIGNMENT), "named": sensitive_matches(F.col(text), NAMED)}
    narrow = rows.select(*keys, F.octet_length(text).alias("bytes"), *[F.coalesce(c, F.lit(0)).alias(f"{n}_hits") for n, c in counts.items()])
    hits = [F.col(f"{n}_hits") for n in counts]
    total = sum(hits[1:], hits[0])
    return narrow.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_if(total > 0).alias("rows_hit"),
        *[F.sum(h).alias(f"{n}_hits") for n, h in zip(counts, hits, strict=True)],
    )


def leaks(rows: DataFrame, text: str) -> DataFrame:
    """Rows in which a credential shape survives; none after redaction."""
    return rows.where(leaking(F.col(text)))


def leaking(x: Column) -> Column:
    """Whether a credential shape survives in a text; a pattern is tried only where the text has its sign."""
    login = URI.replace(f"({_NS}/@]+)@", f"(?!\\[REDACTED\\]@)({_NS}/@]+)@")
    return (_has(x, *_VENDOR_SIGNS) & x.rlike(VENDOR)) | (_has(x, "-----BEGIN ") & x.rlike(PEM)) | (_has(x, "://") & x.rlike(login))


# -- nested arguments: small Python helpers, a batch at a time -------------------------------------------------------


def _sensitive(name: str) -> bool:
    normal = re.sub("[^a-z0-9]", "", name.lower())
    return normal in SENSITIVE or normal.endswith(SENSITIVE_ENDS)


def _plain(text: str) -> str:
    """redact_text() for one Python string."""
    for pattern, put in ((PEM, ""), (AUTHORIZATION, r"\1"), (API_HEADER, r"\1"), (FLAG, r"\1\2"), (USER, r"\1\2\3")):
        text = re.sub(pattern, put + MARK, text)
    text = re.sub(URI, rf"\1\2:{MARK}@", text)

    def by_name(found: re.Match[str]) -> str:
        head = re.match(_HEAD, found[0])
        return head[0] + MARK if head and _sensitive(head[2]) else found[0]

    text = re.sub(ASSIGNMENT, by_name, text)
    text = re.sub(NAMED.replace("|$)", "|\\Z)"), by_name, text)
    return re.sub(VENDOR, MARK, text)


def _hidden(value: object) -> object:
    """Every leaf replaced."""
    if isinstance(value, list):
        return [_hidden(x) for x in value]
    if isinstance(value, dict):
        return {k: _hidden(x) for k, x in value.items()}
    return MARK


def _nested(value: object) -> object:
    if isinstance(value, str):
        return _plain(value)
    if isinstance(value, list):
        out = [_nested(x) for x in value]
        for i, flag in enumerate(value[:-1]):
            if isinstance(flag, str) and flag.strip() in ("-u", "--user") and isinstance(value[i + 1], str):
                out[i + 1] = MARK
        return out
    if isinstance(value, dict):
        out = {}
        for name, child in value.items():
            normal = re.sub("[^a-z0-9]", "", name.lower())
            login = normal in ("user", "username") and isinstance(child, str) and ":" in child
            out[name] = MARK if _sensitive(name) or login else _hidden(child) if normal in ENVIRONMENTS else _nested(child)
        return out
    return value


def _arguments(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        value = json.loads(text)
    except ValueError:
        return _plain(text)
    return json.dumps(_nested(value), ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(StringType())
def _arguments_udf(texts: pd.Series) -> pd.Series:
    return texts.map(_arguments, na_action="ignore")


def redact_arguments(text: Column) -> Column:
    """Arguments that are JSON stay valid JSON; nested values go by their names; other text is redacted as text.

    Only texts that begin like JSON objects, lists or strings are read in Python; other rows cross as nulls.
    """
    like_json = text.rlike(r'^\s*[\[{"]')
    return F.when(like_json, _arguments_udf(F.when(like_json, text))).otherwise(redact_text(text))


def _shown(value: object) -> str:
    """One argument on a line: strings quoted, everything at most 80 characters and an ellipsis."""
    if isinstance(value, bool) or value is None:
        return {True: "true", False: "false", None: "null"}[value]
    if isinstance(value, (int, float)):
        return str(int(value)) if float(value).is_integer() else repr(value)
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    line = re.sub(f"[{WIDE_SPACE}]+", " ", text).strip(" ")
    line = line[:80] + "…" if len(line) > 80 else line
    return f"'{line}'" if isinstance(value, str) else line


def _rendered(text: str | None) -> str:
    if text is None:
        return ""
    try:
        value = _nested(json.loads(text))
    except ValueError:
        value = _plain(text)
    line = ", ".join(map(_shown, value.values())) if isinstance(value, dict) else _shown(value)
    return (line[:200] + "…" if len(line) > 200 else line) if isinstance(value, dict) else line


@F.pandas_udf(StringType())
def _rendered_udf(texts: pd.Series) -> pd.Series:
    return texts.map(_rendered, na_action="ignore")


def render_arguments(text: Column) -> Column:
    """The redacted values of a call's JSON arguments in one line, in the order recorded, without their names."""
    return F.when(text.isNull(), F.lit("")).otherwise(_rendered_udf(text))
