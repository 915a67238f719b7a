"""Three-valued "not among the dropped ids"."""

import pytest
from helpers import clean_rows, raw_tickets

from queuelens.operators.materiality import mat_date_rows_dropped
from queuelens.profile import TicketProfile

TICKETS = [
    {"ticket_id": "a", "resolution_hours": 1.0},
    {"ticket_id": "b", "resolution_hours": 2.0},
    {"ticket_id": "b", "resolution_hours": 4.0},
    {"ticket_id": "c", "resolution_hours": 8.0},
    {"ticket_id": None, "resolution_hours": 100.0},
]


@pytest.mark.parametrize(
    "dropped, volume, median",
    [
        ([], 5, 4.0),  # NOT IN of nothing keeps the ticket without id
        (["a"], 3, 4.0),  # otherwise it is unknown, hence gone
        (["a", "c"], 2, 3.0),
        (["a", None], 0, None),  # one unknown among the dropped: nothing is known to stay
    ],
)
def test_rows_dropped(spark, dropped, volume, median):
    raw = raw_tickets(
        spark,
        {"ticket_id": "b"},
        *[{"ticket_id": i, "created_at": "10/01/2025 10:00"} for i in dropped],
    )
    out = mat_date_rows_dropped(raw, clean_rows(spark, *TICKETS), TicketProfile()).first()
    assert (out["volume_if_dropped"], out["tickets_lost"]) == (volume, 5 - volume)
    assert out["median_if_dropped"] == median
