from journeykit.functions.rules import (
    channel_group,
    page_template,
    source_group,
    source_type,
)
from journeykit.functions.columns import (
    epoch_millis,
    first_by_order,
    majority_value,
)

__all__ = [
    "channel_group",
    "page_template",
    "source_group",
    "source_type",
    "epoch_millis",
    "first_by_order",
    "majority_value",
]
