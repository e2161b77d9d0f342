"""Every operator bound to the test tables, next to the SQL that must agree with it."""
