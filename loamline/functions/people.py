"""Names and addresses of people in commits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

USER = "struct<name:string,email:string>"
_TRAILER = r"(?md)^\s*Co-authored-by:(.*)$"
_NAMED = r"(?d)^(.*)<([^>]+)>\s*$"


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends; null where nothing is left."""
    return F.nullif(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit(""))


def user(name: Column, email: Column) -> Column:
    return F.struct(name.alias("name"), email.alias("email"))


def folded(person: Column) -> Column:
    """The person in lower case; people are the same if this is."""
    return user(F.lower(person["name"]), F.lower(person["email"]))


def co_authors(message: Column) -> Column:
    """People of the trailers of a message: "name <address>", an address alone, or a name alone."""

    def one(text: Column) -> Column:
        named = text.rlike(_NAMED)
        bare = trimmed(text)
        name = F.when(named, trimmed(F.regexp_extract(text, _NAMED, 1))).when(~text.contains("@"), bare)
        email = F.when(named, trimmed(F.regexp_extract(text, _NAMED, 2))).when(text.contains("@"), bare)
        return user(name, email)

    return F.transform(F.regexp_extract_all(F.coalesce(message, F.lit("")), F.lit(_TRAILER), 1), one)


def summary(message: Column) -> Column:
    """The first line of a message."""
    return F.coalesce(trimmed(F.split(trimmed(message), "\n")[0]), F.lit("[no message]"))


def first_paragraph(message: Column) -> Column:
    """The first paragraph of a message as one line: white space that holds a line feed becomes a space."""
    paragraph = F.regexp_extract(trimmed(message), r"(?s)\A(.*?)(?:\n[ \t\r\f\x0b]*(?:\n.*)?)?\z", 1)
    return F.coalesce(trimmed(F.regexp_replace(paragraph, r"[ \t\r\f\x0b]*\n\s*", " ")), F.lit("[no message]"))


def people_of_change(author: Column, committer: Column, others: Column) -> Column:
    """Everyone who had a part in a change, in order (a missing name first), each once."""
    everyone = F.concat(F.coalesce(others, F.array().cast(f"array<{USER}>")), F.array(author, committer))
    return F.array_sort(F.array_distinct(everyone))
