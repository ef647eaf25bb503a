"""Dictionary extraction, ordered rules and the pair scoring policy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Points of a match; weights sum to 100 and bands fall."""

    direction: int = 20
    skills: int = 45
    education: int = 10
    experience: int = 15
    projects: int = 10
    project_points: int = 5
    no_skills: int = 20
    bands: tuple[tuple[int, str], ...] = ((85, "高匹配"), (65, "较匹配"), (45, "基本匹配"))
    lowest: str = "低匹配"

    def __post_init__(self) -> None:
        weights = (self.direction, self.skills, self.education, self.experience, self.projects)
        if min(weights) < 0 or sum(weights) != 100:
            raise ValueError("weights must be 0 or more and sum to 100")
        limits = [b for b, _ in self.bands]
        falling = all(a > b for a, b in zip(limits, limits[1:], strict=False)) and all(0 <= b <= 100 for b in limits)
        if not falling or not 0 <= self.no_skills <= self.skills:
            raise ValueError("bands must fall strictly within 0..100, and no_skills lie within the skill weight")

    def score(self, direction: Column, required: Column, matched: Column, education: Column, experience: Column, projects: Column) -> Column:
        """The sum of points; halves round to even."""
        skill = F.when(required > 0, F.bround(self.skills * matched / required)).otherwise(self.no_skills).cast("int")
        points = lambda ok, n: F.when(ok, n).otherwise(0)
        return points(direction, self.direction) + skill + points(education, self.education) + points(experience, self.experience) + F.least(
            F.lit(self.projects), projects * self.project_points
        )

    def level(self, score: Column) -> Column:
        out = F.lit(self.lowest)
        for limit, name in reversed(self.bands):
            out = F.when(score >= limit, name).otherwise(out)
        return out


def dictionary_hits(text: Column, vocabulary: dict[str, list[str]]) -> Column:
    """Canonical names, in order, of which an alias stands in the text as a whole word."""
    hits = []
    for name, aliases in vocabulary.items():
        pattern = "|".join("\\Q" + a.lower() + "\\E" for a in aliases)
        hits.append(F.when(F.lower(text).rlike(f"(^|[^a-z0-9])({pattern})([^a-z0-9]|$)"), F.lit(name)))
    return F.array_compact(F.array(*hits))


def argmax(counts: dict[str, Column]) -> Column:
    """The name with the highest count, the first of ties; empty where all are 0."""
    best = F.greatest(*counts.values())
    out = F.lit("")
    for name, n in reversed(list(counts.items())):
        out = F.when((n == best) & (best > 0), name).otherwise(out)
    return out


def first_rule(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(otherwise)
    for ok, name in reversed(rules):
        out = F.when(F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return out


#: Chinese digits, words after a year that make it a date, and drives that a cohort's year names.
DIGITS = {"零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
NUMBER = "([0-9]+|[零一二两三四五六七八九十]+)"
DATED, COHORT = ("毕业", "入学", "应届", "在校", "出生", "届"), "校招|社招|春招|秋招"
#: Characters after a year in which such words count.
NEAR = 12


def number(c: Column) -> Column:
    """A decimal number, or a Chinese one below 100; 0 for other Chinese ones, null for none or over nine digits."""
    digits = F.create_map(*(F.lit(x) for pair in DIGITS.items() for x in pair))
    of = lambda x, other: F.coalesce(F.try_element_at(digits, x), F.lit(other))
    chinese = F.when(F.contains(c, F.lit("十")), of(F.substring_index(c, "十", 1), 1) * 10 + of(F.regexp_replace(c, "^[^十]*十", ""), 0)).otherwise(of(c, 0))
    return F.when(c.rlike("^[0-9]{1,9}$"), c.try_cast("int")).when(c.rlike("^[零一二两三四五六七八九十]+$"), chinese)


def years(text: Column) -> Column:
    """The largest duration of 1 to 50 years, 0 if none. Years of graduation, birth and the like are none, nor are
    those from 20 on that name a recruiting drive."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")
    dated = "|".join(f".{{0,{NEAR - len(w)}}}{w}" for w in DATED)
    pattern = F.lit(rf"(?Us){NUMBER}\s*年(?!{dated})({COHORT})?")
    found = F.arrays_zip(F.regexp_extract_all(plain, pattern, F.lit(1)).alias("n"), F.regexp_extract_all(plain, pattern, F.lit(2)).alias("drive"))
    every = F.transform(found, lambda f: F.struct(number(f["n"]).alias("n"), f["drive"].alias("drive")))
    lasting = F.filter(every, lambda f: f["n"].between(1, 50) & ((f["n"] < 20) | (f["drive"] == "")))
    return F.coalesce(F.array_max(F.transform(lasting, lambda f: f["n"])), F.lit(0))


def required_years(text: Column) -> Column:
    """The lower plausible bound of the first range of years, 0 if neither is; without a range as :func:`years`."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")
    span = rf"(?U){NUMBER}\s*[-~～至到]\s*{NUMBER}\s*年"
    bounds = F.filter(F.array(*(number(F.regexp_extract(plain, span, g)) for g in (1, 2))), lambda n: n.between(1, 50))
    return F.when(plain.rlike(span), F.coalesce(F.array_min(bounds), F.lit(0))).otherwise(years(text))


#: Degrees by rank; fixed values.
DEGREES = (("博士", 5), ("硕士", 4), ("研究生", 4), ("本科", 3), ("大专", 2), ("中专", 1))


def rank_of_degree(text: Column) -> Column:
    """The rank of the highest degree named, 0 for none."""
    rank = F.lit(0)
    for word, r in reversed(DEGREES):
        rank = F.when(F.contains(text, F.lit(word)), r).otherwise(rank)
    return rank


def required_degree(text: Column) -> Column:
    """The rank of the highest degree named, 0 where it is only preferred."""
    return F.when(F.contains(text, F.lit("优先")), 0).otherwise(rank_of_degree(text))
