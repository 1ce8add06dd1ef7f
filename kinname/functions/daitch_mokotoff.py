"""Daitch-Mokotoff codes: longest letter clusters from left to right, with branches, six digits each."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the published method: codes at the start, before a vowel and elsewhere, then the clusters
#: that have them; - is not coded, | parts branches.
RULES = """
0 - -              a e i o u
7 7 7              b f p v w fb pf ph
3 3 3              d t dt th
5 5 5              g k q kh
5 5 -              h
8 8 8              l
6 6 6              m n
9 9 9              r
4 4 4              s z
5 54 54            x chs ks
1 - -              y ia ie io iu
1 1 -              eu
0 1 -              ai aj ay ei ej ey oi oj oy ui uj uy ue
0 7 -              au
66 66 66           mn nm
2 4 4              schtsch schtsh schtch shtch shtsh stsch zhdzh shch stch strz strs stsh szcz szcs zdzh zdz sc
4 4 4              ttsch ttch tsch ttsz zsch csz czs drz drs dsh dsz dzh dzs sch tch trz trs tsh tts ttz tzs tsz zsh
4 4 4              cz cs ds dz sh sz ts tc tz zh zs
2 43 43            scht schd sht szt shd szd zhd st sd zd
4|5 4|5 4|5        c ch
5|45 5|45 5|45     ck
4|94 4|94 4|94     rs rz
1|4 -|4 -|4        j
3|4 3|4 3|4        ţ ț
- - -|6            ę ą
"""
#: Fixed values of the published method: letters that count as others.
FOLDS = dict(zip("ßàáâãäåæçèéêëìíîïðñòóôõöøùúûýþÿćłśżź", "saaaaaaaceeeeiiiidnoooooouuuybyclszz", strict=True))
_VOWELS = frozenset("aeiou")


@lru_cache(1)
def rules() -> tuple[dict[str, tuple[list[str], list[str], list[str]]], dict[str, str], int]:
    """Clusters with their codes at the start, before a vowel and elsewhere; letter foldings; longest cluster."""
    table = {}
    for line in RULES.strip().splitlines():
        *codes, _ = fields = line.split()[:4]
        for cluster in line.split()[len(fields) - 1 :]:
            table[cluster] = tuple([x.replace("-", "") for x in c.split("|")] for c in codes)
    return table, FOLDS, max(map(len, table))


class Coder:
    """Codes of names by a rule table that travels with it; executors need no jar. Remembers recent names."""

    def __init__(self, table: dict, fold: dict, longest: int):
        self.rules = table, fold, longest
        self._known = lru_cache(200_000)(self._codes)

    def __reduce__(self):
        return Coder, self.rules

    def __call__(self, name: str | None) -> list[str] | None:
        """The distinct codes of a name, in the order of discovery; None if it has no letter with a code."""
        return self._known(name)

    def _codes(self, name: str | None) -> list[str] | None:
        table, fold, longest = self.rules
        letters = "".join(c for c in (fold.get(c, c) for c in (name or "").lower()) if c in table or "a" <= c <= "z")
        if not letters:
            return None
        branches: dict[tuple[str, str], None] = {("", ""): None}  # (digits, last code)
        at, before = 0, ""
        while at < len(letters):
            size = next((k for k in range(min(longest, len(letters) - at), 0, -1) if letters[at : at + k] in table), 0)
            if not size:
                at += 1
                continue
            follows = letters[at + size : at + size + 1]
            codes = table[letters[at : at + size]][0 if at == 0 else 1 if follows in _VOWELS and follows else 2]
            # M and N in a row are both coded though their codes are equal
            force = {before, letters[at]} == {"m", "n"}
            fresh: dict[tuple[str, str], None] = {}
            for digits, last in branches:
                for code in codes:
                    grown = digits if last.endswith(code) and last and not force else (digits + code)[:6]
                    fresh[grown, code] = None
            branches = fresh
            before = letters[at]
            at += size
        return list(dict.fromkeys(d.ljust(6, "0") for d, _ in branches))


@lru_cache(1)
def coder() -> Coder:
    return Coder(*rules())


def codes_of(name: str | None) -> list[str] | None:
    """The codes of a Python string, for literals that the optimiser folds predicates with."""
    return coder()(name)


@lru_cache(1)
def _clusters() -> tuple[str, str, dict[str, list[str]]]:
    """The regex of the longest cluster at a place, that of what is no letter with a code, and clusters by their first letter."""
    table, _, _ = rules()
    by: dict[str, list[str]] = {}
    for cluster in sorted(table, key=lambda c: (-len(c), c)):
        by.setdefault(cluster[0], []).append(cluster)
    longest = "|".join(f"{first}(?:{'|'.join(c[1:] for c in found)})" if len(found) > 1 else found[0] for first, found in sorted(by.items()))
    return longest, f"[^a-z{''.join(sorted(first for first in by if not first.isascii()))}]", by


@lru_cache(1)
def _rules_sql() -> str:
    """For each first letter, in the order of _clusters, a map from clusters to their codes at the three places."""
    table, _, _ = rules()
    lists = lambda codes: "array(" + ", ".join(f"'{c}'" for c in codes) + ")"
    return "array(" + ", ".join("map(" + ", ".join(f"'{c}', array({', '.join(map(lists, table[c]))})" for c in found) + ")" for found in _clusters()[2].values()) + ")"


def codes(name: Column) -> Column:
    """The codes as an array; null for a null name and where nothing can be coded. An expression, without Python.

    A regex cuts the letters into longest clusters; a fold over them carries the branches, as pairs of
    the digits so far and the last code, and appends each code that the last one does not end with.
    """
    _, fold, _ = rules()
    longest, others, by = _clusters()
    known = F.expr(_rules_sql())  # one text, as each literal by itself is a call of the JVM
    letters = F.regexp_replace(F.translate(F.lower(name), "".join(fold), "".join(fold.values())), others, "")
    clusters = F.regexp_extract_all(letters, F.lit(f"({longest})"), F.lit(1))
    first = lambda at: F.substring(at, 1, 1)

    def step(cluster: Column, i: Column, all_: Column) -> Column:
        after, before = first(F.get(all_, i + 1)), first(F.get(all_, i - 1))
        place = F.when(i == 0, 0).when(after.isin(*sorted(_VOWELS)), 1).otherwise(2)
        force = F.coalesce(F.concat(before, first(cluster)).isin("mn", "nm"), F.lit(False))  # both coded though equal
        of = F.get(known, F.instr(F.lit("".join(by)), first(cluster)) - 1)
        return F.struct(F.get(F.try_element_at(of, cluster), place).alias("codes"), force.alias("force"))

    def grown(branch: Column, code: Column, force: Column) -> Column:
        repeats = (branch["last"] != "") & F.endswith(branch["last"], code) & ~force
        return F.struct(F.when(repeats, branch["digits"]).otherwise(F.substring(F.concat(branch["digits"], code), 1, 6)).alias("digits"), code.alias("last"))

    # the clusters go through one variable, so they are cut once
    steps = F.flatten(F.transform(F.array(clusters), lambda all_: F.transform(all_, lambda c, i: step(c, i, all_))))
    start = F.array(F.struct(F.lit("").alias("digits"), F.lit("").alias("last")))
    ends = F.aggregate(steps, start, lambda branches, s: F.array_distinct(F.flatten(F.transform(branches, lambda b: F.transform(s["codes"], lambda c: grown(b, c, s["force"]))))))
    found = F.array_distinct(F.transform(ends, lambda b: F.rpad(b["digits"], 6, "0")))
    return F.when(F.length(letters) > 0, found)


def codes_sql(name: str) -> str:
    """The same expression as SQL text."""
    _, fold, _ = rules()
    longest, others, by = _clusters()
    of = f"get({_rules_sql()}, instr('{''.join(by)}', substr(c, 1, 1)) - 1)"
    letters = f"regexp_replace(translate(lower({name}), '{''.join(fold)}', '{''.join(fold.values())}'), '{others}', '')"
    vowels = ", ".join(f"'{v}'" for v in sorted(_VOWELS))
    step = (
        f"struct(get(try_element_at({of}, c), CASE WHEN i = 0 THEN 0 WHEN substr(get(a, i + 1), 1, 1) IN ({vowels}) THEN 1 ELSE 2 END) AS codes, "
        "coalesce(concat(substr(get(a, i - 1), 1, 1), substr(c, 1, 1)) IN ('mn', 'nm'), false) AS force)"
    )
    grown = "struct(CASE WHEN b.last <> '' AND endswith(b.last, k) AND NOT s.force THEN b.digits ELSE substr(concat(b.digits, k), 1, 6) END AS digits, k AS last)"
    steps = f"flatten(transform(array(regexp_extract_all({letters}, '({longest})', 1)), a -> transform(a, (c, i) -> {step})))"
    ends = f"aggregate({steps}, array(struct('' AS digits, '' AS last)), (z, s) -> array_distinct(flatten(transform(z, b -> transform(s.codes, k -> {grown})))))"
    return f"CASE WHEN length({letters}) > 0 THEN array_distinct(transform({ends}, b -> rpad(b.digits, 6, '0'))) END"
