"""The same id expressions as DuckDB SQL, for the oracle queries."""


def clean(c: str) -> str:
    return f"trim({c}, ' ' || chr(9) || chr(10) || chr(13))"


def route_from_trip(t: str) -> str:
    return (
        f"CASE WHEN instr({t}, '_') = 0 OR instr({t}, '_') = length({t}) THEN {t} "
        f"ELSE split_part(substr({t}, instr({t}, '_') + 1), '.', 1) END"
    )


def route(route_id: str = "route_id", trip: str = "trip_id") -> str:
    own = f"coalesce({clean(route_id)}, '')"
    return f"CASE WHEN {own} = '' THEN {route_from_trip(clean(trip))} ELSE {own} END"


MEASUREMENT = "type IN ('ARRIVAL_DELAY', 'DEPARTURE_DELAY') AND delay_seconds IS NOT NULL"
