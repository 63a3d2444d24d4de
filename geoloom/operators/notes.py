"""Line-wise rewriting of release notes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_view_links(line: Column, site: str) -> Column:
    """A tile URL of the site that follows other text gets a link to its view."""
    return F.regexp_replace(line, rf"^(.*) ({re.escape(site)}.+/)(\{{z\}}/\{{x\}}/\{{y\}}.pbf)", "$1 $2$3 - [view]($2view)")


def fix_license_link(line: Column, old: str, new: str) -> Column:
    """The old licence address to the new one."""
    return F.replace(line, F.lit(old), F.lit(new))


def fix_license_text(line: Column, old: str, new: str, url: str) -> Column:
    """The text of links to the licence from the old wording to the new one."""
    return F.replace(line, F.lit(f"[{old}]({url})"), F.lit(f"[{new}]({url})"))


def add_data_links(line: Column, prefix: str) -> Column:
    """A line that ends in an archive's name gets a link to it; a name that stands alone also becomes a heading. Lines are trimmed."""
    trimmed = F.regexp_replace(line, r"^\s+|\s+$", "")

    def linked(whole: Column) -> Column:
        name = F.regexp_replace(whole, ":$", "")
        words = F.filter(F.split(name, " "), lambda w: w != "")
        last = F.element_at(words, -1)
        link = F.concat(F.lit("["), last, F.lit(f"]({prefix}/"), last, F.lit(")"))
        alone = F.concat(F.lit("### "), link)
        return F.when(F.size(words) == 1, alone).otherwise(F.array_join(F.concat(F.slice(words, F.lit(1), F.size(words) - 1), F.array(link)), " "))

    return F.when(trimmed.rlike(r"(\.7z:|\.zip:|\.7z)$"), linked(trimmed)).otherwise(trimmed)


def rewrite_notes(df: DataFrame, rules: list, body: str = "body") -> DataFrame:
    """Apply line rules in order; adds ``new_body`` and ``changed``."""

    def all_rules(line: Column) -> Column:
        for rule in rules:
            line = rule(line)
        return line

    new = F.array_join(F.transform(F.split(body, "\n"), all_rules), "\n")
    return df.withColumn("new_body", new).withColumn("changed", F.col(body) != F.col("new_body"))
