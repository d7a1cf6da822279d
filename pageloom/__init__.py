"""pageloom: analytics of how well agents can reach and read pages, expressed as Spark DataFrame plans."""
