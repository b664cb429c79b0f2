"""Schemas of the engine's tables, as DDL strings."""

READS = "lib_id int, rec_id long, pre string, read string, post string, qual string"
SAM = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, nm int, xa string"
CONTIGS = "rname string, seq string"
KMERS = "canon string, n long"
NODES = "node_id int, seq string, len int, marg_len int, kmer_cov long, read_start_cov long"
ARCS = "src int, dst int, cov long"
INDEX = "canon string, node_id int, pos int, forward boolean"
SEEDS = "rec_id long, chain array<int>, node_first int, read_first int, read_end int"
ALIGNMENTS = "rec_id long, aligned boolean, score int, branch boolean, pos_first int, pos_last int, chain array<int>, corrected string"
MARKOV = "ord int, chain array<int>, next_node int, freq long, avg_len double, accepted boolean, odds double"
