"""Column expressions: functions from Column to Column."""
