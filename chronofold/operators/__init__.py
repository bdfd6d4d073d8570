"""DataFrame operators: validity, fold, recovery, comparison, checks, metrics, operations, graphs, faults, simulation."""
