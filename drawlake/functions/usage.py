"""Token counters of a provider's usage document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The counters that are kept, by their path.
COUNTERS = (
    "input_tokens", "output_tokens", "total_tokens", "prompt_tokens", "completion_tokens",
    "cache_creation_input_tokens", "cache_read_input_tokens",
    "output_tokens_details.reasoning_tokens", "completion_tokens_details.reasoning_tokens",
    "input_tokens_details.cached_tokens", "prompt_tokens_details.cached_tokens",
)


def counters(document: Column) -> dict[str, Column]:
    """Each counter of a JSON text by its name, dots as double underscores; null unless it is a whole number of 0 or more.

    Numbers with a fraction or exponent, texts and truth values do not count, nor does anything else of the document.
    """
    usage = F.try_parse_json(document)
    found = {}
    for path in COUNTERS:
        value = F.try_variant_get(usage, f"$.{path}", "bigint")
        whole = F.schema_of_variant(F.try_variant_get(usage, f"$.{path}", "variant")) == "BIGINT"
        found[path.replace(".", "__")] = F.when(whole & (value >= 0), value)
    return found
