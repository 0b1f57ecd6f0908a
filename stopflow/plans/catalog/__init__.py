"""All registered queries, grouped by the part of the blueprint they cover."""

from stopflow.plans.catalog import cleaning, evaluation, features, files, graph, models, profiles, tables  # noqa: F401
