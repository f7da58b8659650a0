"""How multi-job operators are carried out: written stages, hot-key lanes, ranks."""
