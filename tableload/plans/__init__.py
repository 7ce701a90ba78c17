"""Whole loads: from delimited text to a table, or the plan of one."""
