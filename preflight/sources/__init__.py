"""Sources and sinks: the rule catalog, table resolution, changed-file and
diff tables, report and review stores."""
