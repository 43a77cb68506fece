"""Column functions on texts and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language of a file name's ending.
LANGUAGES = {
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "tsx",
    "py": "python", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp",
    "hpp": "cpp", "rb": "ruby", "php": "php",
}
#: Patterns of an instruction's category, in order of precedence.
CATEGORIES = (
    ("anti-patterns", r"\bnever\b|\bdon'?t\b|\bdo not\b|\bavoid\b|\bno\s|\bstop\s|\bforbid"),
    ("decisions", r"\bchose\b|\bdecided\b|\breason\b|\bbecause\b|\brationale\b|\bwhy we\b|\bthe reason\b"),
    ("preferences", r"\bprefer\b|\binstead of\b|\bover\s|\brather than\b|\bswitch to\b|\bmigrate to\b"),
)


def content_hash(col: Column) -> Column:
    """First 32 hexadecimal digits of the SHA-256."""
    return F.left(F.sha2(col, 256), F.lit(32))


def language(path: Column) -> Column:
    """Language of a file by the ending of its name, null if unknown."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), ending)


def slug(col: Column, length: int = 50) -> Column:
    """Lower-case letters and digits joined by single hyphens, at most ``length`` long."""
    kept = F.regexp_replace(F.lower(col), r"[^a-z0-9\s-]", "")
    joined = F.regexp_replace(F.regexp_replace(kept, r"\s+", "-"), "-+", "-")
    return F.regexp_replace(F.left(F.regexp_replace(joined, "^-|-$", ""), F.lit(length)), "-$", "")


def category(col: Column) -> Column:
    """Category of an instruction; ``style`` if no pattern fits, null for null."""
    low = F.lower(col)
    found = F.when(low.isNull(), F.lit(None).cast("string"))
    for name, pattern in CATEGORIES:
        found = found.when(low.rlike(pattern), name)
    return found.when(low.startswith("use ") & ~F.contains(low, F.lit(" in ")), "preferences").otherwise("style")


def words(col: Column) -> Column:
    """ASCII words of a text in lower case, in order."""
    return F.filter(F.split(F.lower(col), "[^a-z0-9]+"), lambda w: w != "")


def letter_words(col: Column) -> Column:
    """Words of letters, their marks and digits of any script in lower case, in order."""
    return F.filter(F.split(F.lower(col), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
