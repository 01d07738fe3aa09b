"""skein: nearest-neighbour scoring of card payments, and the tables around it, as Spark plans."""
