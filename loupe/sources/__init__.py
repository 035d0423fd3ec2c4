"""Sources and sinks: input tables, prediction-run tables, CSV reports, model bundles."""
