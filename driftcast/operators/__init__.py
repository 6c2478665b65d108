"""DataFrame operators: joins, aggregates, windows, schedules, channels, packets."""
