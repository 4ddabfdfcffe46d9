"""Writers: partitioned tables, result texts, WCS headers, benchmark reports."""
