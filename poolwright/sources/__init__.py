"""Readers and writers: tables, image folders, run results, cluster hierarchies, exports."""
