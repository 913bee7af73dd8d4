"""Commerce analytics over orders, invoices, customers and products, on Spark DataFrames."""
