"""TypeScript sources for the tests, and the files table they go into."""

# Sources written for these tests from a list of syntax features: namespace with
# exported members, mapped and union types, decorators on a class and a member,
# an abstract class, generics, several base interfaces, braces inside strings,
# templates and comments, a plain import, an exported call result.
STATION_TS = """type Unit = 'mm' | 'kPa' | 'C';

export namespace Limits {
    export class Window {
        readonly low = 0;
    }
    export interface Alarm {
        text: string;
    }
}

/* a lookup by unit } */
type Scales<U extends Unit> = { [P in U]: number };

interface Labelled {
    label: string;
}

// keeps the latest values
export class Ring<V> {
    constructor(readonly size: number) {}
    push(v: V) { return `${v}{`; }
}

@Registered('probe')
export abstract class Probe {
    @Cached()
    unit(): Unit { return "C"; }
    abstract sample(): number;
}

interface Dated {
    day: number;
}

export interface Entry extends Dated, Labelled {
    value: number;
}
"""

GAUGE_TS = """export function calibrate(offset: number) {
    return (x: number) => x + offset;
}

export const factor = 25.4;

export class RainGauge {
    total = 0;
    add(mm: number) { this.total += mm; }
}
"""

REPORT_TS = """export const monthly = summarise([]);

function summarise(days: number[]) {
    const open = "}{";
    return days.length + open.length;
}

import { RainGauge } from './gauge';

class Sheet {
    rows: number[] = [];
}

interface Cell {
    row: number;
}
"""


def files_df(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "project_id bigint, path string, file_ord bigint, content string")
    return df.withColumn("n_bytes", F.octet_length("content").cast("bigint"))
