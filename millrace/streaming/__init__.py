"""Tick windows, sessions, rolling snapshots and keyed exchange state."""
