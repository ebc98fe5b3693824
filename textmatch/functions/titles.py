"""Title standardisation and normalisation as pure expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmatch.functions.text import SPACE, WORD, WS, collapse, first_of_list, let

# Terms that keep a given spelling when they stand as a word of the title.
PRESERVED = {
    "devops": "DevOps",
    "mysql": "MySQL",
    "postgresql": "PostgreSQL",
    "mongodb": "MongoDB",
    "javascript": "JavaScript",
    "typescript": "TypeScript",
    "nodejs": "NodeJS",
    "reactjs": "ReactJS",
    "vuejs": "VueJS",
    "angularjs": "AngularJS",
    "dotnet": ".NET",
    "aspnet": "ASP.NET",
    "fullstack": "Fullstack",
    "frontend": "Frontend",
    "backend": "Backend",
    "nosql": "NoSQL",
    "graphql": "GraphQL",
    "restapi": "RESTful API",
    "cicd": "CI/CD",
    "android": "Android",
    "ios": "iOS",
}
# Words with their own capitalisation.
SPECIAL = {
    "to": "to",
    "xml": "XML",
    "mean": "MEAN",
    "js": "JS",
    "php": "PHP",
    "css": "CSS",
    "html": "HTML",
    "ui": "UI",
    "ux": "UX",
    "api": "API",
    "aws": "AWS",
    "gcp": "GCP",
    "qa": "QA",
    "sre": "SRE",
    "ml": "ML",
    "ai": "AI",
    "ci": "CI",
    "cd": "CD",
    "it": "IT",
}
# Contract prefixes and seniority words.
PREFIXES = ["fl", "ft", "pt", "temp", "contract", "freelance"]
SENIORITY = [
    "senior", "sr.", "sr", "junior", "jr.", "jr", "lead", "principal", "staff", "intern",
]
# Words written in two halves that belong together.
COMPOUNDS = ["frontend", "backend", "fullstack"]
# Words without meaning for a comparison, and word variants.
COMPARISON_STOP = ["and", "or", "the", "a", "an", "in", "on", "at", "for", "with", "to"]
COMPARISON_MAP = {
    "front": "frontend",
    "frontenddev": "frontend developer",
    "back": "backend",
    "full": "fullstack",
    "ui": "user interface",
    "ux": "user experience",
    "dev": "developer",
    "eng": "engineer",
    "engg": "engineering",
    "arch": "architect",
    "cons": "consultant",
}

UNKNOWN_TITLE = "Unknown Title"
# A private-use character in front of a preserved term keeps track of it, without being
# part of a word, through the steps that follow.
MARK = "\ue000"

_HEAD = f"(?<![{WORD}])"
_TAIL = f"(?![{WORD}])"


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _replace_all(text: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, text)


def _capitalize(word: Column) -> Column:
    # A letter whose capital is two letters keeps only the first of them large.
    first = F.upper(F.substring(word, 1, 1))
    rest = F.concat(F.substring(first, 2, 9), F.substring(word, 2, 2_147_483_647))
    return F.concat(F.substring(first, 1, 1), F.lower(rest))


def _style_word(word: Column) -> Column:
    marked = rf"^([^{MARK}]*){MARK}([{WORD}]+)(.*)$"
    kept = F.concat(
        F.regexp_extract(word, marked, 1),
        F.try_element_at(_lookup(PRESERVED), F.lower(F.regexp_extract(word, marked, 2))),
        F.translate(F.regexp_extract(word, marked, 3), MARK, ""),
    )
    return F.coalesce(
        F.try_element_at(_lookup(SPECIAL), F.lower(word)),
        F.when(F.contains(word, F.lit(MARK)), kept),
        _capitalize(word),
    )


def standardize_title(
    title: Column, profile: str = "full", word_boundary: bool = False
) -> Column:
    """Clean a title and give its words a uniform spelling.

    ``profile='lite'`` leaves prefixes, seniority words and spaced hyphens alone.
    ``word_boundary=True`` removes a leading seniority word only as a whole word; the
    default also eats it from the front of a longer word.
    """
    if profile not in ("full", "lite"):
        raise ValueError(f"unknown profile: {profile}")
    full = profile == "full"

    # 1. Keep the main part of the title and drop numbers.
    steps = [
        (rf"(?s){WS}*\|.*$", ""),
        (rf"(?s){WS}*\(.*$", ""),
        ("&", " / "),
        (rf"(?i){_HEAD}and{_TAIL}", " / "),
        (rf"{_HEAD}\p{{Nd}}+{_TAIL}", ""),
    ]
    if full:
        steps.append((rf"(?i)^({'|'.join(PREFIXES)})\.?{WS}+", ""))
    steps.append((rf"(?s)^{WS}*([^,]*?){WS}*,.*$", "$1"))
    if full:
        if word_boundary:
            words = "|".join(s.replace(".", r"\.") for s in SENIORITY)
            steps.append((rf"(?i)^({words}){_TAIL}\.?{WS}*", ""))
        else:
            words = "|".join(s.replace(".", r"[^\n]") for s in SENIORITY)
            steps.append((rf"(?i)^({words})\.?{WS}*", ""))
    text = _replace_all(first_of_list(title), steps)

    # 2. Mark preserved terms; a title that holds one is lower-cased as a whole.
    preserved = rf"{_HEAD}({'|'.join(PRESERVED)}){_TAIL}"
    text = let(
        text,
        lambda t: F.when(
            F.lower(t).rlike(preserved),
            F.regexp_replace(F.lower(t), preserved, MARK + "$1"),
        ).otherwise(t),
    )

    # 3. Join hyphenated words; next to a preserved term the hyphen becomes a blank.
    hyphen = " ?- ?" if full else "-"
    steps = [
        (rf"([{WORD}]){hyphen}({MARK})", "$1 $2"),
        (rf"({MARK}[{WORD}]+){hyphen}([{WORD}])", "$1 $2"),
        (rf"([{WORD}]+)-([{WORD}]+)", "$1$2"),
    ]
    if full:
        steps += [
            (rf"([{WORD}]+) -([{WORD}]+)", "$1$2"),
            (rf"([{WORD}]+)- ([{WORD}]+)", "$1$2"),
            (rf"([{WORD}]+) - ([{WORD}]+)", "$1$2"),
        ]
    steps.append((f"{WS}*/{WS}*", " / "))
    for head, tail in (("front", "end"), ("back", "end"), ("full", "stack")):
        steps.append(
            (rf"(?i){_HEAD}{head}[{SPACE}-]*{tail}{_TAIL}", (head + tail).capitalize())
        )
    steps.append(("([a-z])([A-Z])", "$1 $2"))
    text = collapse(_replace_all(text, steps))

    # 4. Word by word.
    if full:
        for word in COMPOUNDS:
            halves = "|".join(f"{word[:i]} {word[i:]}" for i in range(1, len(word)))
            text = F.regexp_replace(
                text, f"(?i)(?<![^ ])({halves})(?![^ ])", word.capitalize()
            )
    words = F.filter(F.split(text, " "), lambda w: w != "")
    if full:
        words = F.filter(words, lambda w: ~F.lower(w).isin(SENIORITY))
    styled = F.array_join(F.transform(words, _style_word), " ")
    return F.when(F.coalesce(title, F.lit("")) == "", F.lit(UNKNOWN_TITLE)).otherwise(styled)


def normalize_title(title: Column, standardized: bool = False) -> Column:
    """A comparison key: lower-case words without punctuation, fillers and variants.

    Pass ``standardized=True`` for a title that already went through
    :func:`standardize_title`; doing that twice can change it.
    """
    text = title if standardized else standardize_title(title)
    text = collapse(F.regexp_replace(F.lower(text), f"[^{WORD}{SPACE}]", ""))
    words = F.filter(F.split(text, " "), lambda w: (w != "") & ~w.isin(COMPARISON_STOP))
    variants = _lookup(COMPARISON_MAP)
    mapped = F.transform(words, lambda w: F.coalesce(F.try_element_at(variants, w), w))
    return F.when(F.coalesce(title, F.lit("")) == "", F.lit("")).otherwise(
        F.array_join(mapped, " ")
    )


def normalize_title_lite(title: Column) -> Column:
    """The comparison key of the lite profile."""
    return F.lower(title)
