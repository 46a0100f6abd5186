"""Presentation edge: display column names and member card text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Column headings of the published tables.
SUMMARY_HEADINGS = {"miembro": "Miembro", "cantidad_aportes": "Aportes", "total": "Total"}
DUES_HEADINGS = {"miembro": "Miembro", "objetivo": "Objetivo", "balance": "Balance"}

# Fixed value: the member card text, filled with (picture file, display name).
CARD_TEMPLATE = ("<div class='member-card'>\n<div class='img-container'>\n"
                 "<img src='images/avatars/%s'/>\n</div>\n\n<h5> %s </h5>\n</div>\n\n")


def display_names(df: DataFrame, headings: dict[str, str]) -> DataFrame:
    """Rename columns for display; columns without a heading keep their name.

    Metadata only: the plan gains one projection and no job runs.
    """
    return df.toDF(*[headings.get(c, c) for c in df.columns])


def member_cards(members: DataFrame, template: str = CARD_TEMPLATE) -> DataFrame:
    """``nombre``, ``avatar_img`` and the filled ``tarjeta`` text per pictured member."""
    pictured = members.where(F.col("avatar_img").isNotNull())
    return pictured.select("nombre", "avatar_img",
                           F.format_string(template, F.col("avatar_img"), F.col("nombre")).alias("tarjeta"))
