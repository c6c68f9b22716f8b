"""Sources and sinks: driver tables, the generated code corpus, repository scans."""
