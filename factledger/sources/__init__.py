"""Scans and sinks: JSON lines, lists, inventories, history and exports."""
