"""pagewright: document-structure analytics as DataFrames."""
