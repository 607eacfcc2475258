"""Sentences of the views, and the functions that fill them in."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: question, title and why of each kind of view --------------
VIEW_TEXTS = {
    "snapshot": {
        "question": "What is in this file?",
        "title": "Dataset Overview",
        "why": "This gives a quick baseline before interpreting the rest of the dashboard.",
    },
    "quality": {
        "question": "Any data issues to know?",
        "title": "Data Quality Notes",
        "why": "These issues can affect how much confidence to place in the results.",
    },
    "map": {
        "question": "Where are records located?",
        "title": "Geographic Distribution",
        "why": "The map shows where records are concentrated. "
               "Points are sampled for speed on large files.",
    },
    "outcome_segment": {
        "question": "Which {segment_low} groups differ most?",
        "title": "{outcome} Rate by {segment}",
        "why": "{lead} has the highest {outcome_low} rate at {lead_text} "
               "among sufficiently large groups.",
    },
    "outcome_measure": {
        "question": "Does {measure_low} change {outcome_low}?",
        "title": "{outcome} Rate by {measure} Range",
        "why": "The highest {outcome_low} rate appears in {best}.",
    },
    "metric_segment": {
        "question": "Which {segment_low} groups stand out?",
        "title": "{metric} by {segment}",
        "why": "{lead} stands out with the highest {metric_low} ({lead_text}).",
    },
    "time_count": {
        "question": "How does row volume change over {date_low}?",
        "title": "Rows Over {date}",
        "why": "This shows whether activity is rising, falling, or concentrated "
               "in specific periods.",
    },
    "time_metric": {
        "question": "How does {measure_low} change over time?",
        "title": "{metric} Over {date}",
        "why": "This tracks how {measure_low} changes over time.",
    },
    "relationship": {
        "question": "Do {x_low} and {y_low} move together?",
        "title": "{y} by {x} Range",
        "why": "As {x_low} changes, {y_low} values {direction}. "
               "Treat this as a lead for investigation, not proof of cause.",
    },
    "distribution": {
        "question": "What is a normal range for {measure_low}?",
        "title": "Spread of {measure}",
        "why": "Most {measure_low} values are between {low} and {high}, "
               "with some high outliers.",
    },
    "top_category": {
        "question": "Which {segment_low} groups dominate?",
        "title": "Largest {segment} Groups",
        "why": "The largest {segment_low} group is {lead}, representing {lead_text} of rows.",
    },
}

# --- fixed values: what to notice, when a view is built ----------------------
TAKEAWAYS = {
    "overview": "The dataset has {rows} rows, {columns} columns, {missing} missing cells, "
                "and {duplicates} duplicate rows.",
    "quality": "There are {count} data-quality note(s) to review before trusting every result.",
    "table": "{lead} is the first item to inspect, with {metric_low} of {lead_text}.",
    "line": "{metric} ranges from {low} to {high} over the period shown.",
    "histogram": "Most records are concentrated in the tallest bars; "
                 "long tails usually deserve a closer look.",
    "map": "The densest areas on the map show where records are most concentrated.",
    "other": "Start with the highest and lowest values; they usually explain the main pattern.",
}

# --- fixed values: what to notice, when a replacement text repeats the why ---
SPARE_TAKEAWAYS = {
    "overview": "This file has {rows} rows and {columns} columns.",
    "quality": "Review {count} data-quality note(s) before relying on every result.",
    "table": "{lead} stands out with {metric_low} of {lead_text}.",
    "line": "{metric} ranges from {low} to {high} across the period shown.",
    "histogram": "The tallest bars show where most records are concentrated.",
    "map": "The densest areas show where records are most concentrated.",
    "other": "Focus first on the highest and lowest values in this view.",
}

# --- fixed values: direction of a linked pair, and the summary line ----------
TOGETHER = "tend to rise together"
OPPOSITE = "tend to move in opposite directions"
SUMMARY = (
    "Found {count} useful insight views. Start with {title} because it has the strongest "
    "evidence in this file."
)
EMPTY_SUMMARY = (
    "Insights are generated from the strongest patterns found in the file. Review the first few "
    "cards for the clearest opportunities or risks."
)


def fill(template: str, **parts: Column) -> Column:
    """A sentence with each `{name}` replaced by a column."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[
        parts[x] if i % 2 else F.lit(x) for i, x in enumerate(pieces) if i % 2 or x
    ])
