"""Registered queries of the engine's operators over the driver's tables, and the SQL that gives the same rows."""
