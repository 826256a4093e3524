"""Every operator as a query over the test tables, and what it must give as SQL."""
