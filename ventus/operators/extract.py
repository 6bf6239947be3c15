"""Answers cut out of retrieved text by a table of rules."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventus.operators.reply import cleaned, is_usable_answer


@dataclass(frozen=True)
class Rule:
    """For questions that match asked: sentences that match found, told by template ({0} is the sentence, {name} a group of found)."""

    asked: str
    found: str
    template: str = "{0}"
    most: int = 1


# Rules in order; the first that gives something answers.
RULES = (
    Rule(r"\b(?:summary|highlights?|at a glance|overview)\b", r"(?i)\bat a glance\b|\bparticulate pollution remains\b", "{0}", 3),
    Rule(r"\b(?:what is|define|definition|meaning)\b", r"(?i)\b(?:is|are|refers to|means)\b.{20,}", "{0}", 1),
    Rule(r"\b(?:method|methodology|calculated?|how does)\b", r"(?i)\b(?:method\w*|estimat\w+|calculat\w+|convert\w*)\b", "{0}", 2),
    Rule(r"\bwild\s*fires?\b", r"(?i)\bwildfires?\b.*\d|\d.*\bwildfires?\b", "{0}", 2),
    Rule(r"\b(?:rank|ranking|table|most polluted)\b", r"(?i)\b(?:ranks?|ranked|most polluted)\b", "{0}", 3),
    Rule(r"\b(?:page|pages|website|site)\b", r"(?i)\b(?:page|website)\b", "- {0}", 6),
)


def extract(snippets: DataFrame, question: str, id_col: str, text_col: str, rules: tuple[Rule, ...] = RULES) -> list[str]:
    """The lines of the first rule that the question calls for and the snippets can meet; snippets are the few that retrieval found."""
    sentences = snippets.select(id_col, F.posexplode(F.split(F.col(text_col), r"(?<=[.!?])\s+|\n+")).alias("position", "s"))
    sentences = sentences.select(id_col, "position", cleaned(F.col("s")).alias("s")).where(is_usable_answer(F.col("s")))
    for rule in rules:
        if not re.search(rule.asked, question, re.I):
            continue
        hits = sentences.where(F.col("s").rlike(rule.found)).orderBy(id_col, "position").limit(rule.most * 4).collect()
        lines = []
        for row in hits:
            m = re.search(rule.found, row.s)
            line = rule.template.format(row.s, **(m.groupdict() if m else {}))
            if line not in lines:
                lines.append(line)
        if lines:
            return lines[: rule.most]
    return []
