"""Folders of the given tables (a module of its own: ``conftest`` is a name that test folders share)."""

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
