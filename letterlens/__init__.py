"""letterlens: forensic analysis of mail at corpus scale, written as Spark jobs."""
