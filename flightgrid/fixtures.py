"""Survey tables derived from the shared test tables, as SQL that Spark and DuckDB
evaluate alike.  The operators do not know them; the registered queries do."""

from __future__ import annotations

#: Shots of flights: legs of twelve shots flown to and fro, the last of each a turn.
SHOTS = """
select user_id as flight_id, cast(row_number() over (partition by user_id order by event_id) - 1 as int) as ord,
  event_id, ts, value
from events
"""

SHOT_COLUMNS = """
select flight_id, ord, event_id,
  cast(case when ord % 24 < 12 then 43 else -137 end + case when ord % 12 = 11 then 90 else 0 end as double) as flight_yaw_deg,
  case when flight_id % 10 = 0 then null when value > 200 then -80.0 else -90.0 end * 1e0 as gimbal_pitch_deg,
  30e0 + value / 10000 as relative_alt_m,
  cast(ord as double) * case when ord % 24 < 12 then 1 else -1 end as along,
  2e0 * (ord % 12) * case when ord % 24 < 12 then 1 else -1 end + case when ord % 24 < 12 then 0 else 22 end as east_m,
  8e0 * floor(ord / 12e0) as north_m,
  value, ts
from shots_raw
"""


def shots_sql() -> str:
    return f"with shots_raw as ({SHOTS}), fx_shots as ({SHOT_COLUMNS})"


#: Axis-parallel frames of 14 by 10 m around each shot, for overlaps with a known area.
BOXES = "select flight_id, ord as k, event_id, east_m + (value % 3) as x, north_m + (value % 2) as y from fx_shots"
#: Links between customers of consecutive orders.
EDGES = """
select distinct least(a, b) as i, greatest(a, b) as j from (
  select o_custkey as a, lead(o_custkey) over (order by o_orderkey) as b from orders
) t where b is not null and a <> b
"""
