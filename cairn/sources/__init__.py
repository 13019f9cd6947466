"""Reading listings, graphs, sheets, catalogues and rule tables."""
