"""Workloads over the operators, and the panels the registered queries run on."""
