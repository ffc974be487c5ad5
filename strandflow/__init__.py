"""strandflow: sequence, graph, catalogue and corpus analytics expressed as Spark plans."""
